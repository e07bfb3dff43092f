"""Substring dedup: passages of words that stand in two places, by prefix-partitioned window hashes.

This stands in for prefix-partitioned suffix trees, and builds none: a repeat counts from WINDOW words
on, so equality of whole windows decides, and no deeper common prefix is needed. A suffix begins at a
word. Suffixes are partitioned by a prefix of PREFIX words at an anchor: of the PREFIX-word windows inside
each WINDOW-word window, the one with the least hash. Equal windows have equal anchors at equal offsets, so
they meet in one partition, and about one window in ten is an anchor. Prefixes that occur once cannot
lead to a repeat and are left out by a bitmap of fixed size; where it is full nothing is left out. In a
partition windows are sorted by their hashes, and equal neighbours are a repeat. Partitions of more than
HOT_ROWS anchors are split by the hash of the whole window, the longest prefix that matters, where
counting what is equal is enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.streams import grouped, runs
from trailmark.llm.words import chunks, hashes, window_hashes, words_of
from trailmark.operators.freeze import frozen

WINDOW = 35
PREFIX = 16
HOT_ROWS = 1000
SALTS = 32
PARTS = 4

# Text that a task holds as words and hashes at once.
CHUNK_CHARS = 2_000_000

# Bits of the bitmaps of prefixes that occur twice and of hot ones: 16 MB and 2 MB. A prefix that shares
# its bit with such a one is treated like it, which costs time and changes no result.
TWICE_BITS = 27
HOT_BITS = 24


def _anchors(found: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, ...]:
    """Of the words' hashes: prefix hash, place, first window and number of windows of each anchor."""
    least = window_hashes(found, prefix)
    span = window - prefix + 1
    if len(least) < span:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    place = np.lib.stride_tricks.sliding_window_view(least, span).argmin(axis=1)
    place = place + np.arange(len(place))
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return least[place[first]], place[first], first, np.diff(np.append(first, len(place)))


def _row_key(id_column: str, text_column: str) -> list[Column]:
    """Columns that rows share only if they repeat each other."""
    return [
        F.coalesce(F.concat(F.lit("="), F.col(id_column).cast("string")), F.lit("null")).alias("_id"),
        F.xxhash64(text_column).alias("_digest"),
    ]


def _bitmap(prefixes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the top bits of the given prefixes: 2**bits bits, whatever their number."""
    at = F.shiftrightunsigned("prefix", 64 - bits) + 1
    buckets = (
        prefixes.select(at.alias("_at"))
        .groupBy(F.bitmap_bucket_number("_at").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("bitmap"))
    )
    out = np.zeros(1 << (bits - 3), np.uint8)
    for bucket, bitmap in buckets.toLocalIterator():
        start = (bucket - 1) * len(bitmap)
        out[start : start + len(bitmap)] = np.frombuffer(bitmap, np.uint8)[: len(out) - start]
    return out


def _in_bitmap(bitmap: np.ndarray, prefixes: np.ndarray, bits: int) -> np.ndarray:
    at = (prefixes >> np.uint64(64 - bits)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _counted_prefixes(rows: DataFrame, window: int, prefix: int) -> DataFrame:
    """`prefix`, `n` of the anchors' prefixes that occur twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "_text", CHUNK_CHARS):
            found = [
                _anchors(hashes(words_of(text)), window, prefix)[0]
                for text in chunk.column("_text").to_pylist()
            ]
            if found:
                names, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names.view(np.int64)), pa.array(n.astype(np.int64))],
                    names=["prefix", "n"],
                )

    counted = rows.select("_text").mapInArrow(run, "prefix long, n long")
    return counted.groupBy("prefix").agg(F.sum("n").alias("n")).filter("n > 1")


_SUFFIXES = "hot boolean, key long, _id string, _digest long, place int, first int, suffixes binary"
_MARK_NAMES = ["_id", "_digest", "first", "mask"]
_MARKS = "_id string, _digest long, first int, mask long"


def _suffixes(rows: DataFrame, twice, hot, window: int, prefix: int) -> DataFrame:
    """A row per anchor that may occur twice, with the hashes of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "_text", CHUNK_CHARS):
            out: list[tuple] = []
            texts = zip(*(chunk.column(n).to_pylist() for n in ("_id", "_digest", "_text")))
            for row, digest, text in texts:
                found = hashes(words_of(text))
                keys, places, firsts, counts = _anchors(found, window, prefix)
                kept = np.flatnonzero(_in_bitmap(twice.value, keys, TWICE_BITS))
                if not len(kept):
                    continue
                whole = window_hashes(found, window)
                busy = _in_bitmap(hot.value, keys[kept], HOT_BITS).tolist()
                names = keys.view(np.int64)
                for i, is_hot in zip(kept.tolist(), busy):
                    start, end = int(firsts[i]), int(firsts[i] + counts[i])
                    own = whole[start:end].tobytes()
                    out.append((is_hot, int(names[i]), row, digest, int(places[i]), start, own))
            if out:
                kinds = [pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                    names=["hot", "key", "_id", "_digest", "place", "first", "suffixes"],
                )

    return rows.mapInArrow(run, _SUFFIXES)


def _deep_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by prefix: for each anchor the first window and a bit mask of repeated ones."""
    for table in grouped(batches, ["key"]):
        first, place = (table.column(n).to_numpy().astype(np.int64) for n in ("first", "place"))
        packed = table.column("suffixes").to_pylist()
        many = np.fromiter(map(len, packed), np.int64, len(packed)) // 8
        content = np.frombuffer(b"".join(packed), np.uint64)
        owner = np.repeat(np.arange(len(packed)), many)
        inside = np.arange(len(content)) - np.repeat(np.cumsum(many) - many, many)
        offset = place[owner] - first[owner] - inside
        key = table.column("key").to_numpy()[owner]
        order = np.lexsort((content, offset, key))
        same = (
            (key[order][1:] == key[order][:-1])
            & (offset[order][1:] == offset[order][:-1])
            & (content[order][1:] == content[order][:-1])
        )
        repeated = np.zeros(len(content), bool)
        repeated[order[1:][same]] = True
        repeated[order[:-1][same]] = True
        mask = np.zeros(len(packed), np.int64)
        np.bitwise_or.at(mask, owner[repeated], np.int64(1) << inside[repeated])
        kept = pa.array(np.flatnonzero(mask))
        found = table.select(["_id", "_digest", "first"]).take(kept)
        found = found.append_column("mask", pa.array(mask[mask != 0]))
        yield from found.combine_chunks().to_batches()


def _window_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`key`, `window`, `n`: how often a hot prefix has each window, per batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        packed = batch.column("suffixes").to_pylist()
        many = np.fromiter(map(len, packed), np.int64, len(packed)) // 8
        pairs = np.stack(
            [np.repeat(batch.column("key").to_numpy(), many), np.frombuffer(b"".join(packed), np.int64)],
            axis=1,
        )
        found, n = np.unique(pairs, axis=0, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(c)) for c in (*found.T, n.astype(np.int64))],
            names=["key", "window", "n"],
        )


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of anchors, from rows sorted by (key, _salt, _side): lists of windows, then anchors.

    Only the windows of one prefix and one batch are held.
    """
    current, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        out = []
        sides, lists = batch.column("_side").to_numpy(), batch.column("windows")
        for start, end in runs(batch, ["key", "_salt"]):
            name = (batch.column("key")[start].as_py(), batch.column("_salt")[start].as_py())
            if name != current:
                current, held = name, []
            first = start + int((sides[start:end] == 0).sum())
            if first > start:
                held.append(lists.slice(start, first - start).flatten().to_numpy())
            if first == end or not held:
                continue
            held = [np.unique(np.concatenate(held))]
            anchors = batch.slice(first, end - first)
            packed = anchors.column("suffixes").to_pylist()
            many = np.fromiter(map(len, packed), np.int64, len(packed)) // 8
            hit = np.flatnonzero(np.isin(np.frombuffer(b"".join(packed), np.int64), held[0]))
            owner = np.repeat(np.arange(len(packed)), many)[hit]
            inside = hit - (np.cumsum(many) - many)[owner]
            mask = np.zeros(len(packed), np.int64)
            np.bitwise_or.at(mask, owner, np.int64(1) << inside)
            kept = np.flatnonzero(mask)
            found = anchors.select(["_id", "_digest", "first"]).take(pa.array(kept))
            out.append(pa.RecordBatch.from_arrays([*found.columns, pa.array(mask[kept])], names=_MARK_NAMES))
        yield from (found for found in out if found.num_rows)


def _equal_leaves(anchors: DataFrame) -> DataFrame:
    """Marks of hot anchors (key, _id, _digest, first, suffixes), by counting their windows.

    Windows are counted per batch before the shuffle. The anchors of a prefix are spread over SALTS
    tasks, to each of which go the prefix's repeated windows in PARTS lists.
    """
    repeated = (
        anchors.mapInArrow(_window_counts, "key long, window long, n long")
        .groupBy("key", "window")
        .agg(F.sum("n").alias("n"))
        .filter("n > 1")
    )
    lists = (
        repeated.groupBy("key", F.pmod("window", F.lit(PARTS)).alias("_part"))
        .agg(F.collect_list("window").alias("windows"))
        .select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), "windows")
        .withColumn("_side", F.lit(0))
    )
    salt = F.pmod(F.xxhash64("_id", "_digest"), F.lit(SALTS)).cast("int")
    rows = anchors.withColumn("_salt", salt).withColumn("_side", F.lit(1))
    return (
        lists.unionByName(rows, allowMissingColumns=True)
        .repartition("key", "_salt")
        .sortWithinPartitions("key", "_salt", "_side")
        .mapInArrow(_marked, _MARKS)
    )


def _repeated_windows(rows: DataFrame, window: int, prefix: int) -> DataFrame:
    """`_id`, `_digest`, `marks` (array of first window and bit mask) of each text with repeats."""
    context = rows.sparkSession.sparkContext
    prefixes = frozen(_counted_prefixes(rows, window, prefix))
    twice = context.broadcast(_bitmap(prefixes, TWICE_BITS))
    hot = context.broadcast(_bitmap(prefixes.filter(F.col("n") > HOT_ROWS), HOT_BITS))
    found = frozen(_suffixes(rows, twice, hot, window, prefix))

    trees = (
        found.filter("not hot")
        .drop("hot")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_deep_nodes, _MARKS)
    )
    hot_marks = frozen(_equal_leaves(found.filter("hot").drop("hot", "place")))
    return (
        trees.unionByName(hot_marks)
        .groupBy("_id", "_digest")
        .agg(F.collect_list(F.struct("first", "mask")).alias("marks"))
    )


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    prefix: int = PREFIX,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Texts without the passages that stand elsewhere too: all copies go.

    A window is `window` consecutive words of a text. Each word covered by a window that also begins
    anywhere else, in the same text too, is removed; windows are those of the input, not of what is
    left. Per row: the id, `n_words`, `n_removed`, `spans` (array of first word and end of what is
    removed, from 0) and `text`, the kept words joined by single spaces.

    A null text or one without words has no words and an empty text. Repeated rows are copies of each
    other. Null ids are kept, other columns are ignored, an empty table gives an empty result. Windows
    are compared by 64-bit hashes of words. `window` - `prefix` is 0 to 62.
    """
    if not 0 <= window - prefix <= 62 or prefix < 1:
        raise ValueError("window - prefix must be 0 to 62")
    own = docs.select(id_column, text_column)
    rows = own.select(*_row_key(id_column, text_column), F.col(text_column).alias("_text"))
    marks = _repeated_windows(rows, window, prefix)
    keyed = own.select(
        F.col(id_column).alias("id"), F.col(text_column).alias("_text"), *_row_key(id_column, text_column)
    )
    joined = keyed.join(marks, ["_id", "_digest"], "left").select("id", "_text", "marks")
    schema = T.StructType(
        [
            joined.schema["id"],
            *T._parse_datatype_string(
                "n_words long, n_removed long, spans array<struct<start:long,end:long>>, text string"
            ),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "_text", CHUNK_CHARS):
            out = []
            for text, found in zip(*(chunk.column(n).to_pylist() for n in ("_text", "marks"))):
                words = words_of(text)
                if not found:
                    out.append((len(words), 0, [], b" ".join(words).decode("utf-8", "replace")))
                    continue
                cover = np.zeros(len(words) + 1, np.int64)
                for mark in found:
                    first, mask = mark["first"], mark["mask"]
                    while mask:
                        low = mask & -mask
                        at = first + low.bit_length() - 1
                        cover[at] += 1
                        cover[at + window] -= 1
                        mask ^= low
                gone = np.cumsum(cover)[:-1] > 0
                edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
                spans = [{"start": s, "end": e} for s, e in zip(edges[::2], edges[1::2])]
                kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
                out.append(
                    (len(words), len(words) - len(kept), spans, b" ".join(kept).decode("utf-8", "replace"))
                )
            if out:
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                kinds = [pa.int64(), pa.int64(), span, pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [chunk.column("id"), *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]],
                    names=schema.names,
                )

    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_column)
