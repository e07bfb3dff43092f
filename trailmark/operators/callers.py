"""Caller sessions and callbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.columns import (
    NOT_TOLL_FREE,
    toll_free_class,
    whole_days,
    whole_seconds,
)
from trailmark.operators.events import known_caller
from trailmark.operators.ordered import (
    GROUP_ROWS,
    heavy_keys,
    ordered_metrics,
    previous_of,
    ranked,
)


def caller_sessions(events: DataFrame) -> DataFrame:
    """One row per known number and session: first call event, seconds to the last, class.

    Only call events carry a number, so the duration covers those alone.
    """
    start, end = F.min("TimeStamp"), F.max("TimeStamp")
    return (
        events.filter(known_caller())
        .groupBy("CallingNumber", "SessionId")
        .agg(start.alias("TimeStamp"), whole_seconds(start, end).alias("session_duration"))
        .withColumn("TollFreeNumber", toll_free_class(F.col("CallingNumber")))
    )


def caller_counts(calls: DataFrame) -> DataFrame:
    """Per session the number of its `callers`, and of those of the ordinary class."""
    ordinary = F.when(F.col("TollFreeNumber") == NOT_TOLL_FREE, 1)
    return calls.groupBy("SessionId").agg(
        F.count(F.lit(1)).alias("callers"), F.count(ordinary).alias("ordinary_callers")
    )


def callbacks(calls: DataFrame, group_rows: int | None = GROUP_ROWS) -> DataFrame:
    """Caller sessions with their instance per number, whole days since the last call and the
    duration of the last call."""
    metrics = {
        "callback_instance": ranked(),
        "_last_time": previous_of("TimeStamp"),
        "previous_duration": previous_of("session_duration"),
    }
    heavy = heavy_keys(calls, ["CallingNumber"], group_rows)
    order = [F.col("TimeStamp"), F.col("SessionId")]
    placed = ordered_metrics(calls, ["CallingNumber"], order, metrics, heavy, ["TimeStamp"])
    days = whole_days(F.col("_last_time"), F.col("TimeStamp"))
    return placed.withColumn("days_since_last_call", days).drop("_last_time")
