"""Rolling aggregates over daily series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators.ordered import number_rows

# Rows per block when a frame is rolled without series.
BLOCK_ROWS = 10_000


def rolling(
    df: DataFrame,
    columns: dict[str, str],
    by: Sequence[str],
    order: Sequence[str],
    rows: int = 15,
    min_rows: int = 1,
    fn: str = "avg",
) -> DataFrame:
    """`df` with a rolling mean (or "sum") over the last `rows` rows of each series.

    `columns` maps each new column to the column it rolls. The result is null unless at least
    `min_rows` of the rows hold a value, so `rows=min_rows=14` asks for full frames and
    `rows=15, min_rows=1` allows partial ones.

    A series has one row per `order` value, such as one per day. With no `by` the whole frame rolls
    as one series in `order`; it is then rolled block by block, each block preceded by the rows it
    looks back to.
    """
    if by:
        frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - rows, 0)
        return df.withColumns(_rolled(columns, frame, min_rows, fn))
    at = (F.col("_at") - 1).cast("long")
    # A block is as long as a frame at least: a row looks back no further than the block before.
    size = max(BLOCK_ROWS, rows)
    block = F.floor(at / size)
    tail = at % size >= size - (rows - 1)
    blocks = F.when(tail, F.array(block, block + 1)).otherwise(F.array(block))
    numbered = number_rows(df, [F.col(name) for name in order], "_at")
    copies = numbered.withColumn("_own", block).withColumn("_block", F.explode(blocks))
    frame = Window.partitionBy("_block").orderBy("_at").rowsBetween(1 - rows, 0)
    rolled = copies.withColumns(_rolled(columns, frame, min_rows, fn))
    return rolled.filter(F.col("_own") == F.col("_block")).drop("_at", "_own", "_block")


def _rolled(columns, frame, min_rows, fn) -> dict[str, Column]:
    aggregate = {"avg": F.avg, "sum": F.sum}[fn]
    return {
        made: F.when(F.count(column).over(frame) >= min_rows, aggregate(column).over(frame))
        for made, column in columns.items()
    }
