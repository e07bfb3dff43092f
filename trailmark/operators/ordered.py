"""Ordered metrics per group that stay distributed when one group is very large.

A Spark window sorts each of its groups in one task. That is right for ordinary sessions and
callers and wrong for a placeholder id that holds a third of the log. The functions here use a
window for the ordinary groups. Groups above a row limit are cut into ranges: each range is
evaluated on its own, and a small table with one row per range carries what the ranges before and
after it contribute. Both ways give the same rows.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators.freeze import BROADCAST_ROWS, fits, frozen

# Rows that one task may sort or collect as a group.
GROUP_ROWS = 1_000_000
# Heavy keys that are broadcast; more are joined by shuffle.
HEAVY_KEYS = 100_000

# monotonically_increasing_id() holds the partition above these bits, the row below.
_ROW_BITS = 33
_ROW_MASK = (1 << _ROW_BITS) - 1

_WHOLE_GROUP = (Window.unboundedPreceding, Window.unboundedFollowing)


@dataclass(frozen=True)
class Heavy:
    """Keys whose groups exceed the row limit, with the rows they hold together."""

    keys: DataFrame
    rows: int
    group_rows: int
    small: bool = True

    def split(self, df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
        """(ordinary rows, heavy rows) of `df`, without a shuffle while the keys are few and short."""
        marked = self.keys.toDF(*[f"_heavy_{name}" for name in names])
        if self.small:
            marked = F.broadcast(marked)
        same = _all(F.col(name).eqNullSafe(F.col(f"_heavy_{name}")) for name in names)
        return df.join(marked, same, "left_anti"), df.join(marked, same, "left_semi")


def _all(conditions) -> Column:
    return functools.reduce(operator.and_, conditions)


def heavy_keys(
    df: DataFrame, keys: Sequence[str], group_rows: int | None = GROUP_ROWS
) -> Heavy | None:
    """The groups of `keys` with more than `group_rows` rows; None when there are none.

    With `group_rows=None` the caller vouches that there are none, and nothing is counted.

    Costs one pre-aggregated count over the key columns; only where it finds heavy groups is it made
    again, to write them. The limit does not depend on the table.
    """
    if group_rows is None:
        return None
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    if (sizes.agg(F.max("_rows")).first()[0] or 0) <= group_rows:
        return None
    large = frozen(sizes.filter(F.col("_rows") > group_rows))
    rows = large.agg(F.sum("_rows")).first()[0]
    named = large.select(*keys)
    return Heavy(named, rows, group_rows, fits(named, HEAVY_KEYS))


@dataclass(frozen=True)
class Metric:
    kind: str
    column: str | None = None


def numbered() -> Metric:
    """1-based position of the row in its group."""
    return Metric("numbered")


def ranked() -> Metric:
    """1-based rank in which rows equal in the peer columns share a value."""
    return Metric("ranked")


def first_of(column: str) -> Metric:
    """Value of the first row of the group."""
    return Metric("first", column)


def last_of(column: str) -> Metric:
    """Value of the last row of the group."""
    return Metric("last", column)


def next_of(column: str) -> Metric:
    """Value of the following row; null on the last."""
    return Metric("next", column)


def previous_of(column: str) -> Metric:
    """Value of the preceding row; null on the first."""
    return Metric("previous", column)


def total_before(column: str) -> Metric:
    """Sum over the preceding rows of the group, 0 on the first."""
    return Metric("total", column)


def ordered_parts(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    metrics: Mapping[str, Metric],
    heavy: Heavy | None = None,
    peers: Sequence[str] = (),
) -> list[DataFrame]:
    """`df` with the metrics, as one part, or two when there are heavy groups (heavy last).

    `order` decides the row order in a group. Its first columns, named by `peers`, define rows of
    equal rank; they are all of them unless given.
    """
    peer_order = list(order)[: len(peers) or len(order)]
    if heavy is None:
        return [_by_window(df, keys, order, peer_order, metrics)]
    ordinary, large = heavy.split(df, keys)
    return [
        _by_window(ordinary, keys, order, peer_order, metrics),
        _by_ranges(large, keys, order, peers, metrics, heavy),
    ]


def ordered_metrics(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    metrics: Mapping[str, Metric],
    heavy: Heavy | None = None,
    peers: Sequence[str] = (),
) -> DataFrame:
    """As `ordered_parts`, with the parts in one DataFrame."""
    parts = ordered_parts(df, keys, order, metrics, heavy, peers)
    return functools.reduce(DataFrame.unionByName, parts)


def _by_window(df, keys, order, peer_order, metrics) -> DataFrame:
    rows = Window.partitionBy(*keys).orderBy(*order)
    before = rows.rowsBetween(Window.unboundedPreceding, -1)
    made = {}
    # Ranks last: their order is a prefix of the row order, so the rows are sorted only once.
    for name, metric in sorted(metrics.items(), key=lambda item: item[1].kind == "ranked"):
        if metric.kind == "numbered":
            made[name] = F.row_number().over(rows).cast("long")
        elif metric.kind == "ranked":
            made[name] = F.rank().over(Window.partitionBy(*keys).orderBy(*peer_order)).cast("long")
        elif metric.kind == "first":
            made[name] = F.first(metric.column).over(rows)
        elif metric.kind == "last":
            made[name] = F.last(metric.column).over(rows.rowsBetween(*_WHOLE_GROUP))
        elif metric.kind == "next":
            made[name] = F.lead(metric.column).over(rows)
        elif metric.kind == "previous":
            made[name] = F.lag(metric.column).over(rows)
        else:
            made[name] = _or_zero(F.sum(metric.column).over(before))
    return df.select("*", *[column.alias(name) for name, column in made.items()])


def _or_zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0))


def placed_in_ranges(df: DataFrame, keys, order, heavy: Heavy) -> DataFrame:
    """`df` written in ranges of key and order, with the number of its range and place in it.

    All columns of the order cut the ranges, so many rows of one instant do not stay together.
    """
    partitions = max(
        int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
        math.ceil(heavy.rows / heavy.group_rows),
    )
    by_key = [F.col(key) for key in keys]
    return frozen(
        df.repartitionByRange(partitions, *by_key, *order)
        .sortWithinPartitions(*by_key, *order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright("_at", _ROW_BITS))
    )


def _joined_on_range(rows: DataFrame, table: DataFrame, keys, heavy: Heavy) -> DataFrame:
    """`rows` with `table`, one row per range and heavy key, broadcast while few and short."""
    same = [F.col("_range") == F.col("_carry_range")]
    same += [F.col(key).eqNullSafe(F.col(f"_carry_{key}")) for key in keys]
    few = heavy.small and fits(table, BROADCAST_ROWS)
    return rows.join(F.broadcast(table) if few else table, _all(same))


def _by_ranges(df, keys, order, peers, metrics, heavy: Heavy) -> DataFrame:
    placed = placed_in_ranges(df, keys, order, heavy)
    peer_order = list(order)[: len(peers) or len(order)]
    ranks = any(metric.kind == "ranked" for metric in metrics.values())
    peers = F.struct(*peers) if peers and ranks else None
    carried = frozen(_carried(placed, keys, metrics, peers, heavy))
    joined = _joined_on_range(placed, carried, keys, heavy)

    rows = Window.partitionBy(*keys, "_range").orderBy("_at")
    before = rows.rowsBetween(Window.unboundedPreceding, -1)
    made = {}
    for name, metric in metrics.items():
        if metric.kind == "numbered":
            made[name] = F.col("_rows_before") + F.col("_at") - F.col("_first_at") + 1
        elif metric.kind == "ranked":
            inside = Window.partitionBy(*keys, "_range").orderBy(*peer_order)
            made[name] = F.col("_rows_before") + F.rank().over(inside)
            if peers is not None:
                cut = F.col("_peer_start").isNotNull() & peers.eqNullSafe(F.col("_first_peers"))
                made[name] = F.when(cut, F.col("_peer_start")).otherwise(made[name])
        elif metric.kind == "first":
            made[name] = F.col(f"_start.{name}")
        elif metric.kind == "last":
            made[name] = F.col(f"_end.{name}")
        elif metric.kind == "next":
            last = F.col("_at") == F.col("_last_at")
            made[name] = F.when(last, F.col(f"_following.{name}")).otherwise(
                F.lead(metric.column).over(rows)
            )
        elif metric.kind == "previous":
            first = F.col("_at") == F.col("_first_at")
            made[name] = F.when(first, F.col(f"_preceding.{name}")).otherwise(
                F.lag(metric.column).over(rows)
            )
        else:
            made[name] = _or_zero(F.sum(metric.column).over(before)) + F.col(f"_total_{name}")
    return joined.select(*df.columns, *[column.alias(name) for name, column in made.items()])


def _carried(placed: DataFrame, keys, metrics, peers: Column | None, heavy: Heavy) -> DataFrame:
    """Per (key, range): what the other ranges of the key contribute to its rows."""
    values = [F.col(m.column).alias(n) for n, m in metrics.items() if m.column is not None]
    if peers is not None:
        values.append(peers.alias("_peers"))
    row = F.struct(*values, F.lit(True).alias("_present"))
    totals = {n: m.column for n, m in metrics.items() if m.kind == "total"}
    summary = placed.groupBy(*keys, "_range").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min("_at").alias("_first_at"),
        F.max("_at").alias("_last_at"),
        F.min_by(row, "_at").alias("_first_row"),
        F.max_by(row, "_at").alias("_last_row"),
        *[F.sum(column).alias(f"_sum_{name}") for name, column in totals.items()],
    )
    ranges = Window.partitionBy(*keys).orderBy("_range")
    earlier = ranges.rowsBetween(Window.unboundedPreceding, -1)
    both = [F.col(f"_{end}_row._peers").alias(f"_{end}_peers") for end in ("first", "last")]
    carried = summary.select(
        F.col("_range").alias("_carry_range"),
        *[F.col(key).alias(f"_carry_{key}") for key in keys],
        "_first_at",
        "_last_at",
        _or_zero(F.sum("_rows").over(earlier)).alias("_rows_before"),
        F.first("_first_row").over(ranges).alias("_start"),
        F.last("_last_row").over(ranges.rowsBetween(*_WHOLE_GROUP)).alias("_end"),
        F.lead("_first_row").over(ranges).alias("_following"),
        F.lag("_last_row").over(ranges).alias("_preceding"),
        *[_or_zero(F.sum(f"_sum_{n}").over(earlier)).alias(f"_total_{n}") for n in totals],
        *([] if peers is None else both),
    )
    return carried if peers is None else _peer_starts(placed, frozen(carried), keys, peers, heavy)


def _peer_starts(placed: DataFrame, carried: DataFrame, keys, peers: Column, heavy) -> DataFrame:
    """`carried` with `_peer_start`: the rank of the first rows of a range whose equals began in an
    earlier one, null where they did not."""
    ends = carried.select(
        "_carry_range",
        *[f"_carry_{key}" for key in keys],
        "_first_at",
        F.col("_last_peers").alias("_end_peers"),
    )
    # The place of its first row identifies a range of a key.
    begun = (
        _joined_on_range(placed, ends, keys, heavy)
        .filter(peers.eqNullSafe(F.col("_end_peers")))
        .groupBy("_first_at")
        .agg(F.min("_at").alias("_begun_at"))
    )
    ranges = Window.partitionBy(*[f"_carry_{key}" for key in keys]).orderBy("_carry_range")
    earlier = ranges.rowsBetween(Window.unboundedPreceding, -1)
    first, last = F.col("_first_peers"), F.col("_last_peers")
    rank = F.col("_rows_before") + F.col("_begun_at") - F.col("_first_at") + 1
    return (
        carried.join(begun, "_first_at")
        .withColumn("_continues", first.eqNullSafe(F.lag("_last_peers").over(ranges)))
        .withColumn("_began", F.when(~(F.col("_continues") & first.eqNullSafe(last)), rank))
        .withColumn(
            "_peer_start", F.when(F.col("_continues"), F.last("_began", True).over(earlier))
        )
    )


def number_rows(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """`df` with a 1-based position in a total order, numbered range by range.

    The rows are range-sorted in parallel and numbered inside each partition; the partition sizes,
    one row each, give the offsets. Nothing but those sizes meets in one task.
    """
    placed = frozen(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", _ROW_BITS).cast("int")
    row = F.col("_at").bitwiseAND(F.lit(_ROW_MASK))
    # One row per partition of the sort.
    sizes = dict(placed.groupBy(part.alias("_part")).count().collect())
    offsets = [0]
    for index in range(max(sizes, default=0)):
        offsets.append(offsets[-1] + sizes.get(index, 0))
    offset = F.element_at(F.array(*[F.lit(n).cast("long") for n in offsets]), part + 1)
    return placed.select(*df.columns, (offset + row + 1).alias(name))
