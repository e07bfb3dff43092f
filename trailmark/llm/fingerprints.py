"""Document fingerprints: one-permutation MinHash with optimal densification, low bits packed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.words import mixed, shingles, words_of
from trailmark.operators.freeze import frozen

SHINGLE = 5
# 2**BIN_BITS bins, of whose least hash the lowest LOW_BITS are kept.
BIN_BITS = 8
LOW_BITS = 4
_BINS = 1 << BIN_BITS
# Donor bins tried in one go for the empty ones.
_TRIES = 32


def _donors(empty: np.ndarray, attempt: int) -> np.ndarray:
    """Bins that empty bins ask for their value, for _TRIES attempts on: a hash of bin and attempt."""
    tries = np.arange(attempt, attempt + _TRIES, dtype=np.uint64)
    mix = mixed((empty.astype(np.uint64)[:, None] << np.uint64(32)) + tries[None, :] + np.uint64(1))
    return (mix >> np.uint64(64 - BIN_BITS)).astype(np.int64)


def sketch(hashes: np.ndarray) -> np.ndarray | None:
    """The low bits of the least hash of each bin; None of an empty set. `hashes` are sorted."""
    if not len(hashes):
        return None
    bins = (hashes >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    low = np.zeros(_BINS, np.uint8)
    full = np.zeros(_BINS, bool)
    low[bins[first]] = (hashes[first] & np.uint64((1 << LOW_BITS) - 1)).astype(np.uint8)
    full[bins[first]] = True
    empty, attempt = np.flatnonzero(~full), 0
    while len(empty):
        donors = _donors(empty, attempt)
        hit = full[donors]
        found = hit.any(axis=1)
        low[empty[found]] = low[donors[found, hit[found].argmax(axis=1)]]
        empty, attempt = empty[~found], attempt + _TRIES
    return low


def packed(low: np.ndarray | None) -> str:
    """The fingerprint as hexadecimal text; empty for an empty set."""
    if low is None:
        return ""
    bits = np.unpackbits(low[:, None], axis=1)[:, 8 - LOW_BITS :]
    return np.packbits(bits).tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Estimated Jaccard similarity: equal bins, corrected for those equal by chance, in [0, 1].

    Two empty sets are alike, an empty and another set are not.
    """
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 1.0 / (1 << LOW_BITS)
    return min(1.0, max(0.0, (float((a == b).mean()) - chance) / (1.0 - chance)))


def sketch_text(text: str) -> np.ndarray | None:
    return sketch(shingles(words_of(text), SHINGLE))


def fingerprint(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id and `fingerprint` of each row, from the shingles of five words of its whole text.

    A text of fewer words is one shingle; a null text or one without words has the fingerprint "".
    Rows are independent: null and repeated ids stay, other columns are ignored, nothing is shuffled.
    """
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [packed(sketch_text(t or "")) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(found, pa.string())], names=["_id", "fingerprint"]
            )

    kind = rows.schema["_id"].dataType.simpleString()
    done = rows.mapInArrow(run, f"_id {kind}, fingerprint string")
    return done.withColumnRenamed("_id", id_column)


def edited(text: str, following: str) -> str:
    """`text` with its last half replaced by the first as many code points of `following`, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_COLUMNS = [
    ("kind", pa.string()),
    ("part", pa.int32()),
    ("_id", None),
    ("_text", pa.string()),
    ("n_chars", pa.int64()),
    ("_edited", pa.string()),
    ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()),
    ("near_next", pa.float64()),
]


def _probe(text: str, own: np.ndarray | None, following: str, next_own: np.ndarray | None) -> tuple:
    changed = edited(text, following)
    other = sketch_text(changed)
    return (
        len(text),
        changed,
        packed(own),
        packed(other),
        likeness(own, other),
        likeness(own, next_own),
    )


def edit_probe(
    docs: DataFrame,
    digest: Callable[[str], str],
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """How the fingerprint answers an edit: each text, half of it replaced by the next row's text.

    Columns: the id, `n_chars`, `edited_sha256` (`digest` of the edited text), `fingerprint`,
    `edited_fingerprint`, `near_edited` and `near_next`, the likeness to the edited and to the next
    text. Next is by ascending id, null ids first, equal ids by text; after the last row comes the
    first. Null texts are empty. Repeated rows are neighbours of each other. An only row is its own
    next. Other columns are ignored; an empty table gives an empty result.

    Rows are range-sorted by id once, and each task pairs neighbours in its range. The first and
    last row of every range are paired in a second step, two rows per partition of the sort.
    """
    kind = docs.schema[id_column].dataType
    rows = (
        docs.select(F.col(id_column).alias("_id"), F.coalesce(text_column, F.lit("")).alias("_text"))
        .repartitionByRange("_id")
        .sortWithinPartitions("_id", "_text")
    )

    def record(kept: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*kept))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t or ids) for c, (_, t) in zip(columns, _COLUMNS)],
            names=[name for name, _ in _COLUMNS],
        )

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last = None
        for batch in batches:
            kept = []
            ids = batch.schema.field("_id").type
            for row, text in zip(*(batch.column(n).to_pylist() for n in ("_id", "_text"))):
                own = sketch_text(text)
                if last is None:
                    kept.append(("head", part, row, text, *[None] * 6))
                else:
                    found = _probe(*last[1:], text, own)
                    kept.append(("row", part, last[0], None, found[0], digest(found[1]), *found[2:]))
                last = (row, text, own)
            if kept:
                yield record(kept, ids)
        if last is not None:
            yield record([("tail", part, last[0], last[1], *[None] * 6)], ids)

    names = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long", pa.float64(): "double"}
    schema = ", ".join(f"{n} {names[t] if t else kind.simpleString()}" for n, t in _COLUMNS)
    found = frozen(rows.mapInArrow(pairs, schema))

    # One row per range of the sort.
    parts = sorted(row[0] for row in found.filter("kind = 'head'").select("part").collect())
    following = dict(zip(parts, [*parts[1:], *parts[:1]]))
    steps = docs.sparkSession.createDataFrame(list(following.items()), "part int, _next int")
    heads = found.filter("kind = 'head'").select(
        F.col("part").alias("_next"), F.col("_text").alias("_following")
    )
    edges = (
        found.filter("kind = 'tail'").select("part", "_id", "_text").join(steps, "part").join(heads, "_next")
    )

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for part, row, text, after in zip(
                *(batch.column(n).to_pylist() for n in ("part", "_id", "_text", "_following"))
            ):
                done = _probe(text, sketch_text(text), after, sketch_text(after))
                kept.append(("row", part, row, None, done[0], digest(done[1]), *done[2:]))
            if kept:
                yield record(kept, batch.schema.field("_id").type)

    closed = edges.mapInArrow(close, schema)
    return (
        found.filter("kind = 'row'")
        .unionByName(closed)
        .select(
            F.col("_id").alias(id_column),
            "n_chars",
            F.col("_edited").alias("edited_sha256"),
            "fingerprint",
            "edited_fingerprint",
            "near_edited",
            "near_next",
        )
    )
