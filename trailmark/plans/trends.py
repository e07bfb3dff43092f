"""Daily trends with rolling columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.operators.daily import (
    daily_callbacks,
    daily_events,
    daily_path_length,
    daily_path_metrics,
    daily_sessions,
    daily_top_paths,
)
from trailmark.operators.events import filter_events, within_dates
from trailmark.operators.freeze import frozen
from trailmark.operators.ordered import GROUP_ROWS
from trailmark.operators.paths import (
    path_frequencies,
    rank_paths,
    session_paths,
    sessions_on,
)
from trailmark.operators.rolling import rolling

# Paths shown in a trend; rows of the two kinds of rolling frame.
TOP_PATHS = 10
PARTIAL_FRAME = {"rows": 15, "min_rows": 1}
FULL_FRAME = {"rows": 14, "min_rows": 14}

_FLOW_KEYS = ["SessionId", "FlowName"]


def daily_session_trend(exits: DataFrame, flows=None, approximate: bool = False) -> DataFrame:
    """Distinct sessions per day and flow, with the mean of up to 15 rows."""
    daily = daily_sessions(exits, flows, approximate)
    return rolling(daily, {"avg_14_day_count": "count"}, ["FlowName"], ["date"], **PARTIAL_FRAME)


def flow_trend(exits: DataFrame, flows=None) -> DataFrame:
    """Sessions and mean path length per day and flow, each with the mean of up to 15 rows."""
    columns = {"avg_14_day_count": "count", "avg_14_day_pathLength": "avg_pathLength"}
    daily = daily_path_length(exits, flows)
    return rolling(daily, columns, ["FlowName"], ["date"], **PARTIAL_FRAME)


def top_paths(
    events: DataFrame,
    flows=None,
    start=None,
    end=None,
    k: int = TOP_PATHS,
    group_rows: int | None = GROUP_ROWS,
) -> DataFrame:
    """The k most frequent session paths with their rank and nickname."""
    kept = filter_events(events, flows, start, end)
    paths = session_paths(kept, _FLOW_KEYS, group_rows)
    return rank_paths(path_frequencies(paths), k)


def top_path_trend(
    events: DataFrame,
    flows=None,
    start=None,
    end=None,
    k: int = TOP_PATHS,
    group_rows: int | None = GROUP_ROWS,
) -> DataFrame:
    """Sessions and mean duration per day for the k most frequent paths, with rolling means."""
    kept = filter_events(events, flows, start, end)
    paths = frozen(session_paths(kept, _FLOW_KEYS, group_rows))
    top = frozen(rank_paths(path_frequencies(paths), k))
    columns = {"avg_14_day_count": "count", "avg_14_day_avg_duration": "avg_duration"}
    daily = daily_path_metrics(paths, top)
    return rolling(daily, columns, ["nickname"], ["date"], **PARTIAL_FRAME)


def sessions_on_path(
    events: DataFrame,
    nickname: str,
    flows=None,
    start=None,
    end=None,
    scope: str = "filtered",
    k: int = TOP_PATHS,
    group_rows: int | None = GROUP_ROWS,
) -> DataFrame:
    """Distinct sessions on one of the k most frequent paths of the flows and dates.

    With scope "filtered" the paths are those of the events within flows and dates. With "all" the
    paths cover all events; the flows and the dates, of session starts, only decide the ranks, and
    sessions of any flow and date that share the path are returned.
    """
    if scope not in ("filtered", "all"):
        raise ValueError("scope must be 'filtered' or 'all'")
    if scope == "filtered":
        events = filter_events(events, flows, start, end)
    paths = frozen(session_paths(events, _FLOW_KEYS, group_rows))
    ranked = paths if scope == "filtered" else filter_events(paths, flows, start, end)
    top = frozen(rank_paths(path_frequencies(ranked), k))
    return sessions_on(paths, top, nickname)


def top_path_trend_from_sequence(
    sequence: DataFrame,
    k: int = TOP_PATHS,
    by: Sequence[str] = ("path_nickname",),
    callers: DataFrame | None = None,
) -> DataFrame:
    """Sessions and mean duration per day for the k nicknames with most steps.

    Rolling means need 14 full rows. `by=()` rolls through the frame without regard to the path. With
    `callers` the sequence is a factorised one's steps.
    """
    return rolled_top_paths(daily_top_paths(sequence, k, callers), by)


def rolled_top_paths(daily: DataFrame, by: Sequence[str] = ("path_nickname",)) -> DataFrame:
    columns = {"avg_14_day_avg_duration": "avg_duration", "avg_14_day_count": "count"}
    order = ["date"] if by else ["path_nickname", "date"]
    return rolling(daily, columns, by, order, **FULL_FRAME)


def daily_event_trend(sequence: DataFrame, by: Sequence[str] = ("FlowName",)) -> DataFrame:
    """Steps per day and flow with the mean of 14 full rows; `by=()` rolls across flows."""
    return rolled_events(daily_events(sequence), by)


def rolled_events(daily: DataFrame, by: Sequence[str] = ("FlowName",)) -> DataFrame:
    order = ["date"] if by else ["date", "FlowName"]
    return rolling(daily, {"avg_14_day_count": "count"}, by, order, **FULL_FRAME)


def callback_trend(sequence: DataFrame, callers: DataFrame | None = None) -> DataFrame:
    """Callback metrics per day and toll-free class with means of 14 full rows.

    With `callers` the sequence is a factorised one's steps.
    """
    return rolled_callbacks(daily_callbacks(sequence, callers))


def rolled_callbacks(daily: DataFrame) -> DataFrame:
    columns = {
        "avg_14_day_avg_duration": "avg_duration",
        "avg_14_day_avg_previous_duration": "avg_previous_duration",
        "avg_14_day_count": "count",
    }
    return rolling(daily, columns, ["TollFreeNumber"], ["date"], **FULL_FRAME)


def trend_frame(
    df: DataFrame, series: str, metrics: Sequence[str], start=None, end=None
) -> DataFrame:
    """Long form of a daily trend: (series, date, metric, rolling, value, metric_max).

    Each metric gives a raw and a rolling line; `metric_max` is the largest value of the line over
    all series, the height of a date band. `start` and `end` mark the band in `in_band`.
    """
    df = frozen(df)  # small, and read for the lines and for their largest values
    lines = [
        F.struct(
            F.lit(metric).alias("metric"),
            F.lit(rolled).alias("rolling"),
            F.col(f"avg_14_day_{metric}" if rolled else metric).cast("double").alias("value"),
        )
        for metric in metrics
        for rolled in (True, False)
    ]
    long = df.select(
        F.col(series).alias("series"), "date", F.explode(F.array(*lines)).alias("_line")
    ).select("series", "date", "_line.*")
    # Two rows per metric.
    largest = long.groupBy("metric", "rolling").agg(F.max("value").alias("metric_max"))
    long = long.join(F.broadcast(largest), ["metric", "rolling"])
    if start is not None or end is not None:
        long = long.withColumn("in_band", within_dates("date", start, end))
    return long
