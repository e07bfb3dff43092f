from trailmark.operators.callers import callbacks, caller_sessions
from trailmark.operators.daily import (
    daily_callbacks,
    daily_events,
    daily_path_length,
    daily_path_metrics,
    daily_sessions,
    daily_top_paths,
    top_nicknames,
)
from trailmark.operators.events import available_flows, call_events, filter_events, unify_events
from trailmark.operators.freeze import intermediate_tables
from trailmark.operators.graph import (
    flow_links,
    flow_nodes,
    highlight_path,
    link_ids,
    threshold_links,
)
from trailmark.operators.paths import (
    keyed_paths,
    name_paths,
    path_frequencies,
    path_pieces,
    rank_paths,
    session_paths,
    sessions_on,
)
from trailmark.operators.repeats import repeat_call_stats
from trailmark.operators.rolling import rolling
from trailmark.operators.sketches import daily_session_sketches, sketched_sessions
from trailmark.operators.steps import step_metrics

__all__ = [
    "available_flows",
    "call_events",
    "callbacks",
    "caller_sessions",
    "daily_callbacks",
    "daily_events",
    "daily_path_length",
    "daily_path_metrics",
    "daily_session_sketches",
    "daily_sessions",
    "daily_top_paths",
    "filter_events",
    "flow_links",
    "flow_nodes",
    "highlight_path",
    "intermediate_tables",
    "keyed_paths",
    "link_ids",
    "name_paths",
    "path_frequencies",
    "path_pieces",
    "rank_paths",
    "repeat_call_stats",
    "rolling",
    "session_paths",
    "sessions_on",
    "sketched_sessions",
    "step_metrics",
    "threshold_links",
    "top_nicknames",
    "unify_events",
]
