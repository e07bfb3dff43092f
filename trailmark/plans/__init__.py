from trailmark.plans.dashboard import DashboardFrames, dashboard_frames
from trailmark.plans.flowgraph import (
    compare_periods,
    flow_graph,
    flow_graph_from_log,
    log_sequence,
)
from trailmark.plans.sequence import (
    FactorisedSequence,
    FilterCounts,
    date_at_percent,
    dates_at_percents,
    factorised,
    factorised_sequence,
    in_order,
    restrict_counted,
    restrict_tollfree,
    restrict_window,
    step_sequence,
    user_sequence,
)
from trailmark.plans.summary import (
    SequenceSummary,
    merge_summaries,
    read_summary,
    refreshed,
    refreshed_at,
    summarise,
)
from trailmark.plans.trends import (
    callback_trend,
    daily_event_trend,
    daily_session_trend,
    flow_trend,
    sessions_on_path,
    top_path_trend,
    top_path_trend_from_sequence,
    top_paths,
    trend_frame,
)

__all__ = [
    "DashboardFrames",
    "FactorisedSequence",
    "FilterCounts",
    "SequenceSummary",
    "callback_trend",
    "compare_periods",
    "daily_event_trend",
    "daily_session_trend",
    "dashboard_frames",
    "date_at_percent",
    "dates_at_percents",
    "factorised",
    "factorised_sequence",
    "flow_graph",
    "flow_graph_from_log",
    "flow_trend",
    "in_order",
    "log_sequence",
    "merge_summaries",
    "read_summary",
    "refreshed",
    "refreshed_at",
    "restrict_counted",
    "restrict_tollfree",
    "restrict_window",
    "sessions_on_path",
    "step_sequence",
    "summarise",
    "top_path_trend",
    "top_path_trend_from_sequence",
    "top_paths",
    "trend_frame",
    "user_sequence",
]
