"""Flow graphs: from a sequence, from a plain event log, and for several periods."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.dates import as_date
from trailmark.operators.events import filter_events, within_dates
from trailmark.operators.freeze import frozen
from trailmark.operators.graph import (
    flow_links,
    flow_moves,
    highlight_path,
    link_ids,
    links_of,
    nodes_of,
    threshold_links,
)
from trailmark.operators.ordered import GROUP_ROWS
from trailmark.operators.steps import step_metrics


def flow_graph(
    sequence: DataFrame,
    min_count: int | None = None,
    pct: float | None = None,
    highlight: str | None = None,
    by: Sequence[str] = ("path_nickname",),
    sessions: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a sequence; links carry the ids of their nodes.

    The sequence is read once, and added up to a table from which both are made; counting
    `sessions` reads it a second time.
    """
    moves = frozen(flow_moves(sequence, by))
    links = flow_links(sequence, by, sessions) if sessions else None
    return graph_of(moves, min_count, pct, highlight, by, links)


def graph_of(
    moves: DataFrame,
    min_count: int | None = None,
    pct: float | None = None,
    highlight: str | None = None,
    by: Sequence[str] = ("path_nickname",),
    links: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of steps added up by `flow_moves`, or sums of those; no moves, no rows."""
    nodes = nodes_of(moves)
    links = links_of(moves, by) if links is None else links
    if min_count is not None or pct is not None:
        links = threshold_links(links, min_count, pct)
    links = link_ids(links, nodes)
    if highlight is not None:
        links = highlight_path(links, highlight)
    return nodes, links


def log_sequence(
    log: DataFrame,
    user: str = "user_id",
    event: str = "event_name",
    time: str = "time_event",
    tie: str | None = None,
    group_rows: int | None = GROUP_ROWS,
) -> DataFrame:
    """Step metrics for any log of three columns; `tie` orders events of equal time."""
    columns = {user: "SessionId", event: "ActionId", time: "TimeStamp"}
    renamed = [F.col(name).alias(known) for name, known in columns.items()]
    if tie is not None:
        renamed.append(F.col(tie).alias("EventId"))
    steps = step_metrics(log.select(*renamed), group_rows=group_rows)
    return steps.select(
        F.col("SessionId").alias("user_id"),
        F.col("ActionId").alias("event_name"),
        F.col("TimeStamp").alias("time_event"),
        "rank_event",
        "next_event",
        "time_from_start",
        "time_to_next",
        F.lit(1).cast("long").alias("count"),
    )


def flow_graph_from_log(
    log: DataFrame,
    user: str = "user_id",
    event: str = "event_name",
    time: str = "time_event",
    tie: str | None = None,
    min_count: int | None = None,
    pct: float | None = None,
    group_rows: int | None = GROUP_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) straight from a three-column event log."""
    sequence = log_sequence(log, user, event, time, tie, group_rows)
    return flow_graph(sequence, min_count, pct, by=())


def compare_periods(
    events: DataFrame,
    flows,
    periods: Mapping[str, tuple],
    group_rows: int | None = GROUP_ROWS,
) -> DataFrame:
    """Links of the same flows in several date ranges, with a `period` column.

    Ranges include both ends and may overlap. Each period is sequenced from its own events, all in
    one job.
    """
    first = min(as_date(start) for start, _ in periods.values())
    last = max(as_date(end) for _, end in periods.values())
    names = F.array_compact(
        F.array(
            *[
                F.when(within_dates("TimeStamp", start, end), F.lit(name))
                for name, (start, end) in periods.items()
            ]
        )
    )
    dated = filter_events(events, flows, first, last).withColumn("period", F.explode(names))
    steps = step_metrics(dated, ("period", "SessionId"), group_rows)
    sequence = steps.select(
        "period",
        F.col("SessionId").alias("user_id"),
        F.col("ActionId").alias("event_name"),
        "next_event",
        "time_from_start",
        F.lit(1).cast("long").alias("count"),
    )
    return flow_links(sequence, by=("period",))
