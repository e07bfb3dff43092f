"""Distinct sessions over any range of days, from one sketch per day and flow."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.dates import as_list
from trailmark.operators.events import within_dates

# 2 ** LG_K registers: a relative standard error of 1.04 / sqrt(2 ** LG_K), 1.6 %, in 4 KB at most.
LG_K = 12


def relative_error(lg_k: int = LG_K) -> float:
    """The relative standard error of a count from sketches of 2 ** `lg_k` registers."""
    return 1.04 / math.sqrt(2**lg_k)


def daily_session_sketches(exits: DataFrame, flows=None, lg_k: int = LG_K) -> DataFrame:
    """One HyperLogLog sketch of the session ids per `date` and `FlowName`, to be stored by day."""
    if flows is not None:
        exits = exits.filter(F.col("FlowName").isin(as_list(flows)))
    return exits.groupBy(F.to_date("TimeStamp").alias("date"), "FlowName").agg(
        F.hll_sketch_agg("SessionId", lg_k).alias("sketch")
    )


def sketched_sessions(
    sketches: DataFrame, start=None, end=None, by: Sequence[str] = ("FlowName",), lg_k: int = LG_K
) -> DataFrame:
    """Estimated distinct sessions between two dates, both included, by any columns of the sketches.

    Distinct counts of days cannot be added up, as sessions may return; their sketches are merged.
    `low` and `high` are three standard errors away, whole sessions.
    """
    merged = sketches.filter(within_dates("date", start, end)).groupBy(*by).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("sessions")
    )
    margin = 3 * relative_error(lg_k)
    return merged.withColumns(
        {
            "low": F.floor(F.col("sessions") * (1 - margin)),
            "high": F.ceil(F.col("sessions") * (1 + margin)),
        }
    )
