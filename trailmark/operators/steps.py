"""Step metrics of a session: position, next step, seconds from the start and to the next step."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.columns import whole_seconds
from trailmark.operators.events import event_order
from trailmark.operators.ordered import (
    GROUP_ROWS,
    Heavy,
    first_of,
    heavy_keys,
    next_of,
    numbered,
    ordered_parts,
)

_METRICS = {
    "rank_event": numbered(),
    "_started": first_of("TimeStamp"),
    "_next_time": next_of("TimeStamp"),
    "next_event": next_of("ActionId"),
}


def step_parts(
    events: DataFrame, heavy: Heavy | None, keys: tuple[str, ...] = ("SessionId",)
) -> list[DataFrame]:
    """Step metrics for the ordinary sessions and, when there are any, for the heavy ones."""
    parts = ordered_parts(events, keys, event_order(events), _METRICS, heavy)
    seconds = {
        "time_from_start": whole_seconds(F.col("_started"), F.col("TimeStamp")),
        "time_to_next": whole_seconds(F.col("TimeStamp"), F.col("_next_time")),
    }
    return [part.withColumns(seconds).drop("_started", "_next_time") for part in parts]


def step_metrics(
    events: DataFrame,
    keys: tuple[str, ...] = ("SessionId",),
    group_rows: int | None = GROUP_ROWS,
) -> DataFrame:
    """Events with rank_event, next_event, time_from_start and time_to_next per session."""
    heavy = heavy_keys(events, keys, group_rows)
    return functools.reduce(DataFrame.unionByName, step_parts(events, heavy, keys))
