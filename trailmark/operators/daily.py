"""Daily aggregates of exit events, session paths and the enriched sequence."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.columns import path_length
from trailmark.functions.dates import as_list
from trailmark.operators.freeze import BROADCAST_ROWS
from trailmark.operators.paths import name_paths


def _exits_of(exits: DataFrame, flows) -> DataFrame:
    if flows is not None:
        exits = exits.filter(F.col("FlowName").isin(as_list(flows)))
    return exits.withColumn("date", F.to_date("TimeStamp"))


def daily_sessions(exits: DataFrame, flows=None, approximate: bool = False) -> DataFrame:
    """Distinct sessions per date and flow; a sketch when `approximate`."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    count = distinct("SessionId").alias("count")
    return _exits_of(exits, flows).groupBy("date", "FlowName").agg(count)


def daily_path_length(exits: DataFrame, flows=None) -> DataFrame:
    """Distinct sessions and mean path length per date and flow."""
    return (
        _exits_of(exits, flows)
        .withColumn("_length", path_length(F.col("Path")))
        .groupBy("date", "FlowName")
        .agg(F.count_distinct("SessionId").alias("count"), F.avg("_length").alias("avg_pathLength"))
    )


def daily_path_metrics(paths: DataFrame, top: DataFrame) -> DataFrame:
    """Distinct sessions and mean duration per date for each of the `top` ranked paths.

    A path goes through the aggregation as its nickname; its text is added to the result.
    """
    daily = (
        name_paths(paths, top)
        .withColumnRenamed("path_nickname", "nickname")
        .groupBy(F.to_date("TimeStamp").alias("date"), "nickname")
        .agg(
            F.count_distinct("SessionId").alias("count"),
            F.avg("Duration").alias("avg_duration"),
        )
    )
    return daily.join(top.select("nickname", "Path"), "nickname")


def daily_events(sequence: DataFrame) -> DataFrame:
    """Sum of `count`, that is the number of sequence rows, per date and flow."""
    return sequence.groupBy("date", "FlowName").agg(F.sum("count").alias("count"))


# The caller columns behind the daily callback metrics.
CALLBACK_METRICS = {
    "session_duration": "avg_duration",
    "previous_duration": "avg_previous_duration",
    "days_since_last_call": "avg_days_since_last_call",
}


def session_means(
    sequence: DataFrame, series: str, columns: Iterable[str], callers: DataFrame | None = None
) -> DataFrame:
    """Per session, day and `series` the means of caller columns over the rows of the sequence.

    With `callers` given, `sequence` holds steps only (see `FactorisedSequence`). All steps of a session
    have the same callers, so their means over steps and callers are those over the callers, which
    join the distinct days of the session.
    """
    if callers is None:
        means = [F.avg(column).alias(column) for column in columns]
        return sequence.groupBy("user_id", "date", series).agg(*means)
    of_caller = series in callers.columns
    days = sequence.select("user_id", "date", *([] if of_caller else [series])).distinct()
    means = callers.groupBy("user_id", *([series] if of_caller else [])).agg(
        *[F.avg(column).alias(column) for column in columns]
    )
    return days.join(means, "user_id", "left")


def mean_of_sessions(sessions: DataFrame, series: str, metrics: dict[str, str]) -> DataFrame:
    """Daily means of session means: each session counts once however many steps it has."""
    return (
        sessions.dropna(subset=["user_id", "date", series])
        .groupBy(series, "date")
        .agg(
            *[F.avg(column).alias(name) for column, name in metrics.items()],
            F.count(F.lit(1)).alias("count"),
        )
    )


def daily_callbacks(sequence: DataFrame, callers: DataFrame | None = None) -> DataFrame:
    """Per date and toll-free class: sessions, and their mean duration, previous duration and days
    since the last call."""
    sessions = session_means(sequence, "TollFreeNumber", CALLBACK_METRICS, callers)
    return mean_of_sessions(sessions, "TollFreeNumber", CALLBACK_METRICS)


def top_nicknames(sequence: DataFrame, k: int = 10) -> DataFrame:
    """The k path nicknames with most sequence rows, ties by nickname."""
    counts = sequence.groupBy("path_nickname").agg(F.sum("count").alias("_rows"))
    ordered = counts.orderBy(F.col("_rows").desc(), F.col("path_nickname"))
    return ordered.limit(k).select("path_nickname")


def daily_top_paths(
    sequence: DataFrame, k: int = 10, callers: DataFrame | None = None
) -> DataFrame:
    """Sessions and mean session duration per date for the k nicknames with most rows."""
    top = top_nicknames(sequence, k)
    # Nicknames are short: a bounded number of them fits.
    top = F.broadcast(top) if k <= BROADCAST_ROWS else top
    kept = sequence.join(top, "path_nickname", "left_semi")
    sessions = session_means(kept, "path_nickname", ["session_duration"], callers)
    return mean_of_sessions(sessions, "path_nickname", {"session_duration": "avg_duration"})
