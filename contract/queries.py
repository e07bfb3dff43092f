"""Registered queries: each operator over the driver's tables.

All read whole tables. Queries of flows and dates filter by them because that is the feature: operators
that take them as arguments, and those named `_of_flows`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import trailmark as tm
from contract import mapping
from contract.mapping import END, FLOWS, START
from trailmark.functions import path_length

Query = Callable[[SparkSession, str], DataFrame]

CUSTOMER = "1001"
PERIODS = {"early": ("2024-01-03", "2024-01-16"), "late": ("2024-01-16", "2024-01-28")}
WINDOW = ("2024-01-05", "2024-01-20")
SAMPLE = 500
PERCENT = 37
HIGHLIGHT = "6-Path_Freq_Rank"
SLIDER = (10, 90)


def _log(spark, sf_dir):
    return mapping.events_log(spark, sf_dir)


def _kept(spark, sf_dir):
    return tm.filter_events(_log(spark, sf_dir), FLOWS, START, END)


def _sequence(spark, sf_dir):
    return tm.user_sequence(_log(spark, sf_dir), FLOWS, START, END)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals: the order of a floating sum is not part of a result."""
    return df.select(
        *[F.round(name, 6).alias(name) if kind == "double" else name for name, kind in df.dtypes]
    )


def _of_events(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(_log(spark, sf_dir))


def _of_kept(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(_kept(spark, sf_dir))


def _of_exits(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(operator(mapping.exit_events(spark, sf_dir)))


def of_sequence(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(operator(_sequence(spark, sf_dir)))


def _frequencies(events: DataFrame) -> DataFrame:
    return tm.path_frequencies(tm.session_paths(events))


def _nicknames(events: DataFrame) -> DataFrame:
    paths = tm.session_paths(events)
    ranks = tm.rank_paths(tm.path_frequencies(paths))
    return tm.name_paths(paths.select("SessionId", "Path"), ranks)


def _path_lengths(spark, sf_dir):
    paths = tm.session_paths(mapping.conversation_events(spark, sf_dir))
    return paths.select("SessionId", path_length(F.col("Path")).alias("pathLength"))


def _order_calls(spark, sf_dir):
    calls = mapping.order_calls(spark, sf_dir)
    return tm.callbacks(
        calls.select(
            "CallingNumber",
            "SessionId",
            "TimeStamp",
            F.col("CallDuration").alias("session_duration"),
        )
    )


def _call_events(spark, sf_dir):
    calls = mapping.families(spark, sf_dir)["call"]
    return tm.call_events(calls, FLOWS, START, END)


def _repeat_calls(spark, sf_dir, by_toll_free=True):
    calls = tm.call_events(mapping.families(spark, sf_dir)["call"])
    return rounded(tm.repeat_call_stats(calls, by_toll_free))


def _rolling_three(sequence: DataFrame) -> DataFrame:
    daily = tm.daily_callbacks(sequence).select(
        "TollFreeNumber", "date", "avg_duration", "count"
    )
    three = {"by": ["TollFreeNumber"], "order": ["date"], "rows": 3, "min_rows": 3}
    means = tm.rolling(daily, {"mean_3": "avg_duration"}, fn="avg", **three)
    return tm.rolling(means, {"sum_3": "count"}, fn="sum", **three)


def _dashboard(sequence: DataFrame):
    return tm.dashboard_frames(sequence, SLIDER, include_tollfree=False, threshold_pct=10)


def _refreshed(sequence: DataFrame):
    summary = tm.summarise(sequence)
    return tm.refreshed_at(summary, SLIDER, include_tollfree=False, threshold_pct=10)


def of_factorised(operator: Callable[[tm.FactorisedSequence], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(
        operator(tm.factorised_sequence(_log(spark, sf_dir), FLOWS, START, END))
    )


def _sketched_weeks(exits: DataFrame) -> DataFrame:
    """Distinct sessions per flow and week, and whether the merged daily sketches agree with them."""
    week = F.to_date(F.date_trunc("week", "date")).alias("week")
    daily = tm.daily_session_sketches(exits).select("*", week)
    estimated = tm.sketched_sessions(daily, by=("FlowName", "week"))
    exact = (
        exits.select("SessionId", "FlowName", F.to_date("TimeStamp").alias("date"))
        .groupBy("FlowName", week)
        .agg(F.count_distinct("SessionId").alias("exact"))
    )
    return exact.join(estimated, ["FlowName", "week"]).select(
        "FlowName",
        "week",
        F.col("exact").alias("sessions"),
        F.col("exact").between(F.col("low"), F.col("high")).alias("within_error"),
    )


def _stored_in_parts(spark, sf_dir):
    """The sequence of a store to which the log is added in three parts, of days and of a late half."""
    log, store = _log(spark, sf_dir), tm.SequenceStore(spark, mapping.scratch(spark), FLOWS)
    day, late = F.to_date("TimeStamp"), F.col("EventId") % 2 == 1
    for part in (day < WINDOW[0], (day >= WINDOW[0]) & ~late, (day >= WINDOW[0]) & late):
        store.add(log.filter(part))
    return store.sequence()


def _from_files(spark, sf_dir):
    return tm.unify_events(tm.read_events(spark, mapping.family_files(spark, sf_dir)))


def _exits_from_files(spark, sf_dir):
    return tm.read_exit_events(spark, mapping.exit_file(spark, sf_dir))


# Operators without a filter of their own: on the whole log, and, named `_of_flows`, behind the filter of
# flows and dates that stands before them in the user sequence.
BARE: dict[str, Callable[[DataFrame], DataFrame]] = {
    "session_paths": tm.session_paths,
    "session_flow_paths": lambda events: tm.session_paths(events, ["SessionId", "FlowName"]),
    "path_frequencies": _frequencies,
    "path_ranks": lambda events: tm.rank_paths(_frequencies(events)),
    "session_nicknames": _nicknames,
    "caller_sessions": tm.caller_sessions,
    "callbacks": lambda events: tm.callbacks(tm.caller_sessions(events)),
}

# Panels drawn from the enriched sequence.
PANELS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "sequence_window": lambda s: tm.restrict_window(s, *WINDOW),
    "sequence_nontollfree": lambda s: tm.restrict_tollfree(s, include=False),
    "date_at_percent": lambda s: tm.date_at_percent(s, PERCENT),
    "flow_links": tm.flow_links,
    "flow_links_sessions": lambda s: tm.flow_links(s, sessions=True),
    "flow_nodes": tm.flow_nodes,
    "flow_graph": lambda s: tm.flow_graph(s)[1],
    "links_threshold_abs": lambda s: tm.threshold_links(tm.flow_links(s), min_count=3),
    "links_threshold_pct": lambda s: tm.threshold_links(tm.flow_links(s), pct=10),
    "links_highlight": lambda s: tm.highlight_path(tm.flow_links(s), HIGHLIGHT),
    "top_path_trend_from_sequence": tm.top_path_trend_from_sequence,
    "top_path_trend_from_sequence_ungrouped": lambda s: tm.top_path_trend_from_sequence(s, by=()),
    "daily_event_trend": tm.daily_event_trend,
    "daily_event_trend_ungrouped": lambda s: tm.daily_event_trend(s, by=()),
    "callback_trend": tm.callback_trend,
    "rolling_three": _rolling_three,
    "top_nicknames": tm.top_nicknames,
    "daily_top_paths": tm.daily_top_paths,
    "daily_callbacks": tm.daily_callbacks,
    "trend_frame": lambda s: tm.trend_frame(
        tm.top_path_trend_from_sequence(s), "path_nickname", ["count", "avg_duration"], *WINDOW
    ),
    "dashboard_links": lambda s: _dashboard(s).links,
    "dashboard_callbacks": lambda s: _dashboard(s).callbacks,
    "dashboard_nodes": lambda s: _dashboard(s).nodes,
    "dashboard_totals": lambda s: _dashboard(s).totals,
    "dashboard_top_paths": lambda s: _dashboard(s).top_paths,
}

# The same panels from steps and callers side by side.
FACTORISED: dict[str, Callable[[tm.FactorisedSequence], DataFrame]] = {
    "factorised_steps": lambda f: f.steps,
    "factorised_callers": lambda f: f.callers,
    "factorised_links": lambda f: tm.flow_links(f.steps),
    "factorised_nodes": lambda f: tm.flow_nodes(f.steps),
    "factorised_callback_trend": lambda f: tm.callback_trend(f.steps, f.callers),
    "factorised_top_path_trend": lambda f: tm.top_path_trend_from_sequence(
        f.steps, callers=f.callers
    ),
}

# The frames of one refresh merged from daily sums.
REFRESHED: dict[str, Callable[[DataFrame], DataFrame]] = {
    "refreshed_links": lambda s: _refreshed(s).links,
    "refreshed_nodes": lambda s: _refreshed(s).nodes,
    "refreshed_totals": lambda s: _refreshed(s).totals,
    "refreshed_top_paths": lambda s: _refreshed(s).top_paths,
    "refreshed_callbacks": lambda s: _refreshed(s).callbacks,
}

QUERIES: dict[str, Query] = {
    "unified_events": _log,
    "unified_events_all_actions": lambda spark, sf_dir: tm.unify_events(
        mapping.families(spark, sf_dir), drop_actions=()
    ),
    "filtered_events": _kept,
    "customer_events": _of_events(
        lambda log: tm.filter_events(log, start=START, customers=CUSTOMER, start_exclusive=True)
    ),
    "call_events": _call_events,
    "available_flows": _of_exits(tm.available_flows),
    "step_sequence": _of_events(lambda log: tm.step_sequence(log, FLOWS, START, END)),
    **{name: _of_events(operator) for name, operator in BARE.items()},
    **{f"{name}_of_flows": _of_kept(operator) for name, operator in BARE.items()},
    "step_sequence_whole_log": _of_events(tm.step_sequence),
    "user_sequence_whole_log": _of_events(tm.user_sequence),
    "sequence_in_order": lambda spark, sf_dir: tm.in_order(_sequence(spark, sf_dir)),
    "top_paths": _of_events(lambda log: tm.top_paths(log, FLOWS, START, END)),
    "sessions_on_path": _of_events(
        lambda log: tm.sessions_on_path(log, "1-Path_Freq_Rank", FLOWS, START, END)
    ),
    "sessions_on_path_all": _of_events(
        lambda log: tm.sessions_on_path(log, "1-Path_Freq_Rank", FLOWS, START, END, scope="all")
    ),
    "user_sequence": _sequence,
    **{name: of_sequence(panel) for name, panel in PANELS.items()},
    **{name: of_factorised(panel) for name, panel in FACTORISED.items()},
    **{name: of_sequence(frame) for name, frame in REFRESHED.items()},
    "sketched_weeks": _of_exits(_sketched_weeks),
    "stored_in_parts": _stored_in_parts,
    "events_from_files": _from_files,
    "exit_events_from_files": _exits_from_files,
    "daily_sessions": _of_exits(tm.daily_sessions),
    "daily_path_length": _of_exits(tm.daily_path_length),
    "daily_session_trend": _of_exits(lambda exits: tm.daily_session_trend(exits, FLOWS)),
    "flow_trend": _of_exits(tm.flow_trend),
    "top_path_trend": _of_events(lambda log: rounded(tm.top_path_trend(log, FLOWS, START, END))),
    "compare_periods": _of_events(lambda log: rounded(tm.compare_periods(log, FLOWS, PERIODS))),
    "repeat_call_stats": _repeat_calls,
    "repeat_call_stats_by_date": lambda spark, sf_dir: _repeat_calls(spark, sf_dir, False),
    "sample_sessions": _of_events(lambda log: tm.sample_sessions(log, SAMPLE)),
    "order_callbacks": _order_calls,
    "order_repeat_stats": lambda spark, sf_dir: rounded(
        tm.repeat_call_stats(mapping.order_calls(spark, sf_dir))
    ),
    "conversation_path_ranks": lambda spark, sf_dir: tm.rank_paths(
        _frequencies(mapping.conversation_events(spark, sf_dir))
    ),
    "conversation_path_lengths": _path_lengths,
    "conversation_steps": lambda spark, sf_dir: tm.step_sequence(
        mapping.conversation_events(spark, sf_dir)
    ),
    "shipment_steps": lambda spark, sf_dir: tm.log_sequence(mapping.shipment_log(spark, sf_dir)),
    "flow_graph_from_log": lambda spark, sf_dir: rounded(
        tm.flow_graph_from_log(mapping.shipment_log(spark, sf_dir))[1]
    ),
    "flow_graph_from_log_nodes": lambda spark, sf_dir: tm.flow_graph_from_log(
        mapping.shipment_log(spark, sf_dir)
    )[0],
}
