"""Exact top-k search by inner product, with bounds from segment statistics, coarse to fine.

A vector is cut into segments of equal length. With the mean m and the deviation d (root of the summed
squares around the mean) of a segment of n components, the inner product of two segments is at most
n * m1 * m2 + d1 * d2, since what is left around the means cannot agree better than fully. Summed over
the segments this bounds the score from above, and so the distance |q - x|^2 = |q|^2 + |x|^2 - 2 q.x
from below. More and shorter segments give closer bounds at a higher price, so pairs pass the
resolutions one after another, and only survivors of all are scored exactly.

Queries go through the table in groups of bounded size. A group is broadcast, every task compares it
with its own rows block by block and keeps the best k per query, and a ranked window, which Spark
limits to k rows per query before the shuffle, merges the tasks. The number of passes grows with the
number of queries, as the work does; no pass needs more memory than another.
"""

from __future__ import annotations

import contextlib
import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators.freeze import frozen
from trailmark.operators.ordered import number_rows

SCALE = 256
# Segments per vector, coarse to fine; resolutions with fewer than two components a segment fall away.
RESOLUTIONS = (1, 4, 16)
# Bytes of the queries that go through the table together, and rows that give first thresholds.
GROUP_BYTES = 32_000_000
FIRST_ROWS = 2_048
# Queries and rows compared at once inside a task: a block of scores is 8 times their product in bytes.
QUERY_BLOCK = 512
ROW_BLOCK = 2_048
# Below this size, sums of products of whole doubles are exact.
_EXACT = 2.0**53
# Rounding that a bound may have suffered, as a share of the product of the norms.
_SLACK = 1e-9
_LEAST, _MOST = -(2**63), 2**63 - 1
_FOUND = "query long, query_id long, vec_row long, vec_id long, score long"


def usable_vectors(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """`_row` (unique), `_id`, `_dim` and `_v` of the rows whose vector takes part, written.

    Null vectors and those with a null or non-finite component, or one whose scaled value is not
    finite, take no part.
    """
    scaled = F.transform(vector_column, lambda x: x.cast("double") * SCALE)
    finite = F.forall(
        scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    )
    kept = vectors.filter(F.col(vector_column).isNotNull()).filter(finite)
    return frozen(
        kept.select(
            F.monotonically_increasing_id().alias("_row"),
            F.col(id_column).cast("long").alias("_id"),
            F.size(vector_column).alias("_dim"),
            F.col(vector_column).alias("_v"),
        )
    )


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """For each query row its `k` best other rows: `query_id`, `rank`, `vec_id`, `score`.

    Components x become floor(256 * x); the score is the inner product of these whole numbers, exact
    up to 64 bits; beyond them it counts as the nearest long. Ties go to the smaller id, null ids last,
    then to the row written first. Queries are the rows for which `is_query`
    holds. A row is no candidate of its own, but a repeated row with the same id is one, and a query.
    Only vectors of the same length are compared; a query with fewer than `k` other rows gets all.
    """
    rows = usable_vectors(vectors, id_column, vector_column)
    queries = rows.withColumnRenamed("_id", id_column).filter(is_query)
    queries = queries.withColumnRenamed(id_column, "_id")
    numbered = number_rows(queries, [F.col("_dim"), F.col("_row")], "_number")
    total, widest = numbered.agg(F.max("_number"), F.max("_dim")).first()
    found = rows.sparkSession.createDataFrame([], _FOUND)
    if total is not None:
        size = max(1, group_bytes // (8 * max(widest, 1)))
        first = rows.orderBy(F.xxhash64("_row"), "_row").limit(min(size, FIRST_ROWS))
        with _sent(first) as some:
            bounded = functools.partial(_with_thresholds, some=some, k=k)
            fields = [f"{name} {kind}" for name, kind in numbered.dtypes]
            numbered = frozen(numbered.mapInArrow(bounded, ", ".join([*fields, "_least long"])))
        for at in range(1, total + 1, size):
            with _sent(numbered.filter(F.col("_number").between(at, at + size - 1))) as group:
                search = functools.partial(_search, group=group, k=k)
                found = found.unionByName(frozen(rows.mapInArrow(search, _FOUND)))
    best = Window.partitionBy("query").orderBy(
        F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "vec_row"
    )
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id").alias(id_column), "score")


@contextlib.contextmanager
def _sent(rows: DataFrame) -> Iterator[Broadcast]:
    """A bounded number of `rows` on every executor."""
    table = rows.toArrow().combine_chunks()
    sent = rows.sparkSession.sparkContext.broadcast(table)
    try:
        yield sent
    finally:
        sent.destroy()


@dataclass
class _Vectors:
    """Vectors of one length: their whole numbers, and statistics by number of segments."""

    rows: np.ndarray
    ids: np.ndarray
    null: np.ndarray
    values: np.ndarray

    def __post_init__(self):
        self.largest = np.abs(self.values).max(initial=0.0)
        with np.errstate(over="ignore"):
            self.norms = np.sqrt((self.values**2).sum(axis=1))
        dim = self.values.shape[1]
        self.statistics = [self._statistics(n) for n in RESOLUTIONS if 2 * n <= dim]

    def _statistics(self, segments: int) -> np.ndarray:
        """Per segment the mean times the root of its length, and the deviation."""
        edges = np.linspace(0, self.values.shape[1], segments + 1).astype(int)
        sizes = np.diff(edges)
        with np.errstate(over="ignore", invalid="ignore"):
            means = np.add.reduceat(self.values, edges[:-1], axis=1) / sizes
            around = (self.values - np.repeat(means, sizes, axis=1)) ** 2
            deviations = np.sqrt(np.add.reduceat(around, edges[:-1], axis=1))
        return np.hstack([means * np.sqrt(sizes), deviations])

    def part(self, start: int, end: int) -> _Vectors:
        return _Vectors(*(a[start:end] for a in (self.rows, self.ids, self.null, self.values)))


def _by_length(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[_Vectors, np.ndarray]]:
    """The vectors of each length, with their places in `table`."""
    lengths = table.column("_dim").to_numpy()
    column = table.column("_v")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    rows = table.column("_row").to_numpy()
    ids = table.column("_id")
    null = np.asarray(ids.is_null())
    ids = np.asarray(ids.fill_null(0))
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        values = flat[starts[at][:, None] + np.arange(length)]
        yield _Vectors(rows[at], ids[at], null[at], np.floor(values * SCALE)), at


def _scores(queries: _Vectors, rows: _Vectors, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact up to 64 bits and cut off there."""
    left, right = queries.values[q], rows.values[r]
    if math.prod([left.shape[1], float(queries.largest), float(rows.largest)]) < _EXACT:
        return (left @ right.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(left).dot(whole(right).T)
    return np.clip(exact, _LEAST, _MOST).astype(np.int64)


class _Best:
    """The best `k` rows found so far for each of the queries of one length."""

    def __init__(self, queries: _Vectors, k: int, least: np.ndarray):
        self.queries, self.k, self.least = queries, k, least
        blocks = range(0, len(queries.rows), QUERY_BLOCK)
        self.blocks = [(at, queries.part(at, at + QUERY_BLOCK)) for at in blocks]
        self.kept = [np.zeros(0, np.int64)] * 5

    def compare(self, rows: _Vectors) -> None:
        new = [self.kept]
        for at, block in self.blocks:
            q, r, scores = self._survivors(block, rows, self.least[at : at + QUERY_BLOCK])
            if len(q):
                new.append([q + at, rows.rows[r], rows.ids[r], rows.null[r].astype(np.int64), scores])
        if len(new) > 1:
            self._keep([np.concatenate(parts) for parts in zip(*new)])

    def _survivors(self, block: _Vectors, rows: _Vectors, least: np.ndarray):
        """Pairs whose score may be among the best, as places of queries and rows, with scores."""
        q, r = np.arange(len(block.rows)), np.arange(len(rows.rows))
        for mine, theirs in zip(block.statistics, rows.statistics):
            with np.errstate(over="ignore", invalid="ignore"):
                bound = mine[q] @ theirs[r].T
                bound += _SLACK * np.outer(block.norms[q], rows.norms[r])
                alive = ~(bound < least[q, None])  # what overflowed stays
            some = alive.any(axis=1)
            if not some.any():
                return q[:0], r[:0], np.zeros(0, np.int64)
            q, r = q[some], r[alive.any(axis=0)]
        scores = _scores(block, rows, q, r)
        alive = (scores >= least[q, None]) & (block.rows[q, None] != rows.rows[None, r])
        if len(r) > self.k:
            among = np.where(alive, scores, _LEAST)
            alive &= scores >= np.partition(among, len(r) - self.k, axis=1)[:, [len(r) - self.k]]
        found_q, found_r = np.nonzero(alive)
        return q[found_q], r[found_r], scores[found_q, found_r]

    def _keep(self, found: list[np.ndarray]) -> None:
        q, rows, ids, null, scores = found
        order = np.lexsort((rows, ids, null, ~scores, q))
        first = np.flatnonzero(np.diff(q[order], prepend=-1))
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        kept = order[place < self.k]
        self.kept = [column[kept] for column in found]
        last = order[place == self.k - 1]
        self.least[q[last]] = np.maximum(self.least[q[last]], scores[last])


def _with_thresholds(batches, some: Broadcast, k: int) -> Iterator[pa.RecordBatch]:
    """Adds `_least`: the k-th best score of each query among `some` rows, which its best k reach."""
    rows = {v.values.shape[1]: v for v, _ in _by_length(some.value)}
    for batch in batches:
        least = np.full(batch.num_rows, _LEAST)
        for queries, at in _by_length(batch):
            if (others := rows.get(queries.values.shape[1])) is not None:
                best = _Best(queries, k, np.full(len(at), _LEAST))
                best.compare(others)
                least[at] = best.least
        columns = [*batch.columns, pa.array(least)]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_least"])


def _search(batches, group: Broadcast, k: int) -> Iterator[pa.RecordBatch]:
    """The best `k` of this task's rows for each query of the group, as far as they may be the best."""
    least = group.value.column("_least").to_numpy()
    best = {
        queries.values.shape[1]: _Best(queries, k, least[at].copy())
        for queries, at in _by_length(group.value)
    }
    for batch in batches:
        for start in range(0, batch.num_rows, ROW_BLOCK):
            for rows, _ in _by_length(batch.slice(start, ROW_BLOCK)):
                if (found := best.get(rows.values.shape[1])) is not None:
                    found.compare(rows)
    for found in best.values():
        q, rows, ids, null, scores = found.kept
        mine = found.queries
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(mine.rows[q]),
                pa.array(mine.ids[q], mask=mine.null[q]),
                pa.array(rows),
                pa.array(ids, mask=null.astype(bool)),
                pa.array(scores),
            ],
            ["query", "query_id", "vec_row", "vec_id", "score"],
        )
