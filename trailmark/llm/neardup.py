"""MinHash near-dedup: an inverted join on signature coordinates, confirmed on full shingle sets.

Texts of equal shingle sets form a class. Each class has a signature of COORDINATES least hashes and is
posted under its (coordinate, value) keys. Two classes that agree in MIN_MATCHES keys or more share one
of the COORDINATES - MIN_MATCHES + 1 keys that come first in any common order; keys are ordered by how
often they occur, rare ones first, and only these prefixes are posted. Members of a list are compared
with its least and greatest member first, which joins groups of copies without listing their pairs.
Where the members of a list are then not in one component, signatures are compared inside tasks, block
by block. A first pass finds the classes that agree with any class of another component, a second
brings the full sets of these into blocks, confirms inside the task, and keeps only links that join
components not yet joined there. So what leaves a task are members and a forest, never the pairs of a
group, and no link between components is lost. All links are confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from trailmark.llm.keyed import lookup
from trailmark.llm.streams import grouped, runs
from trailmark.llm.words import chunks, hashes_of, mixed, window_hashes
from trailmark.operators.freeze import fits, frozen

SHINGLE = 5
PERCENT = 80
COORDINATES = 64
# At a similarity of 0.8 a signature agrees in 51 of 64 places on average, with a deviation of 3.2:
# one pair in 100,000 falls below this, and fewer of closer pairs.
MIN_MATCHES = 38
PREFIX = COORDINATES - MIN_MATCHES + 1

# Frequencies of keys are counted in so many cells: they only order keys, so shared cells cost time.
CELL_BITS = 16
# Classes whose ids are broadcast to pick the sets to confirm; more are joined by shuffle.
BROADCAST_CLASSES = 1_000_000
# Members of a list that one task compares with as many others.
BLOCK = 1000
# Bytes of packed sets that one task compares with as many others.
BLOCK_BYTES = 4_000_000

_RANDOM = np.random.Generator(np.random.PCG64(1))
_FACTORS = _RANDOM.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RANDOM.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_PLACES = mixed(np.arange(COORDINATES, dtype=np.uint64) + np.uint64(1))
_PIECE = 50_000


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Distinct hashes of the shingles of a text, A-Z in lower case, cut to 48 bits; sorted."""
    of_words = hashes_of(text, lower=True)
    if not len(of_words):
        return np.zeros(0, np.uint64)
    found = window_hashes(of_words, min(size, len(of_words)))
    return np.unique(found >> np.uint64(16))


def _signature(found: np.ndarray) -> np.ndarray:
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), _PIECE):
        piece = mixed(found[start : start + _PIECE])
        least = np.minimum(least, (_FACTORS[:, None] * piece + _OFFSETS[:, None]).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def _pack(found: np.ndarray) -> bytes:
    return np.ascontiguousarray(found.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel()


def _class_of(found: np.ndarray) -> int:
    return int(np.uint64(xxh3_64_intdigest(found.tobytes())).astype(np.int64))


def _keys(signatures: np.ndarray) -> np.ndarray:
    """Posting keys of signatures, one row each."""
    return mixed(signatures.astype(np.uint64) ^ _PLACES)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _described(docs: DataFrame, size: int, carried: list[str], text_column: str) -> DataFrame:
    """The `carried` columns, `n`, `class`, `signature` of each row; the last two null without words."""
    rows = docs.select(*carried, F.col(text_column).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            kept = []
            for text in batch.column("_text"):
                found = shingle_set(text.as_py(), size)
                if len(found):
                    kept.append((len(found), _class_of(found), _signature(found).tobytes()))
                else:
                    kept.append((0, None, None))
            n, classes, signatures = zip(*kept) if kept else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(name) for name in carried],
                    pa.array(n, pa.int64()),
                    pa.array(classes, pa.int64()),
                    pa.array(signatures, pa.binary()),
                ],
                names=[*carried, "n", "class", "signature"],
            )

    kinds = [f"{name} {rows.schema[name].dataType.simpleString()}" for name in carried]
    return rows.mapInArrow(run, ", ".join([*kinds, "n long, class long, signature binary"]))


def _frequencies(classes: DataFrame) -> np.ndarray:
    """How often the keys of each cell occur: 2**CELL_BITS numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            if batch.num_rows:
                cells = _keys(_signatures(batch.column("signature"))) >> np.uint64(64 - CELL_BITS)
                total += np.bincount(cells.ravel().astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    counted = (
        classes.select("signature").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n"))
    )
    total = np.zeros(1 << CELL_BITS, np.int64)
    for cell, n in counted.collect():
        total[cell] = n
    return total


def _prefix(keys: np.ndarray, frequencies: np.ndarray) -> np.ndarray:
    """The places of the first PREFIX keys of each row, rare ones first."""
    often = frequencies[(keys >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
    return np.lexsort((keys, often), axis=1)[:, :PREFIX]


def _postings(classes: DataFrame, shared: Broadcast) -> DataFrame:
    """`key`, `class`: each class under the first PREFIX of its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _keys(_signatures(batch.column("signature")))
            first = np.take_along_axis(keys, _prefix(keys, shared.value), axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(first.ravel().view(np.int64)),
                    pa.array(np.repeat(batch.column("class").to_numpy(), PREFIX)),
                ],
                names=["key", "class"],
            )

    return classes.select("class", "signature").mapInArrow(run, "key long, class long")


def _matching(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """`a`, `b`, `matches` of the pairs whose signatures agree in MIN_MATCHES places."""
    own = classes.select("class", "signature")
    both = (
        pairs.join(own.toDF("a", "sa"), "a").join(own.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            equal = _signatures(batch.column("sa")) == _signatures(batch.column("sb"))
            matches = pa.array(equal.sum(axis=1).astype(np.int64))
            table = pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), matches], names=["a", "b", "matches"]
            )
            yield table.filter(pa.array(matches.to_numpy() >= MIN_MATCHES))

    return both.mapInArrow(run, "a long, b long, matches long")


def _sets(docs: DataFrame, wanted: DataFrame, size: int, text_column: str) -> DataFrame:
    """`class`, `members`: the packed shingle sets of the wanted classes, one row each."""
    few = fits(wanted, BROADCAST_CLASSES)
    listed = None
    if few:
        ids = wanted.select("class").toArrow()["class"].to_numpy()
        listed = docs.sparkSession.sparkContext.broadcast(np.sort(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            kept: dict[int, bytes] = {}
            for text in batch.column("_text"):
                found = shingle_set(text.as_py(), size)
                if not len(found) or (name := _class_of(found)) in kept:
                    continue
                if listed is not None:
                    at = np.searchsorted(listed.value, name)
                    if at == len(listed.value) or listed.value[at] != name:
                        continue
                kept[name] = _pack(found)
            if kept:
                names, members = zip(*kept.items())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(members, pa.binary())],
                    names=["class", "members"],
                )

    found = docs.select(F.col(text_column).alias("_text")).mapInArrow(
        run, "class long, members binary"
    )
    if not few:
        found = found.join(wanted, "class", "left_semi")
    return found.groupBy("class").agg(F.first("members").alias("members"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets overlap enough."""
    both = (
        pairs.select("a", "b")
        .join(sets.toDF("a", "ma"), "a")
        .join(sets.toDF("b", "mb"), "b")
        .select("a", "b", "ma", "mb")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for first, second in zip(batch.column("ma"), batch.column("mb")):
                x, y = _unpack(first.as_py()), _unpack(second.as_py())
                shared = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def connected(links: DataFrame) -> DataFrame:
    """`class`, `component` (its least class) of all that `links` (a, b) join, by label passing.

    Each round takes the least label among neighbours and then the label of the label, so that
    chains shorten by half.
    """
    both = frozen(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = frozen(
        both.groupBy("a")
        .agg(F.min("b").alias("_least"))
        .select(F.col("a").alias("class"), F.least("a", "_least").alias("component"))
    )
    while True:
        around = both.join(labels.toDF("b", "_label"), "b").groupBy("a").agg(
            F.min("_label").alias("_label")
        )
        lower = labels.join(around.withColumnRenamed("a", "class"), "class").select(
            "class", F.least("component", "_label").alias("_next"), "component"
        )
        jumped = lower.join(labels.toDF("_next", "_far"), "_next", "left").select(
            "class",
            F.least("_next", F.coalesce("_far", "_next")).alias("component"),
            F.col("component").alias("_before"),
        )
        jumped = frozen(jumped)
        labels = jumped.select("class", "component")
        if not jumped.filter("component <> _before").limit(1).count():
            return labels


class _Links:
    """Confirmed links so far and the components they make."""

    def __init__(self, spark) -> None:
        self.links = spark.createDataFrame([], "a long, b long")
        self.labels = spark.createDataFrame([], "class long, component long")

    def across(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose classes are not in one component."""
        a = self.labels.toDF("a", "_ca")
        b = self.labels.toDF("b", "_cb")
        return (
            pairs.join(a, "a", "left")
            .join(b, "b", "left")
            .filter(F.coalesce("_ca", "a") != F.coalesce("_cb", "b"))
            .select(*pairs.columns)
        )

    def resolve(self, pending: DataFrame, sets: DataFrame, percent: int) -> None:
        """Confirm pairs: the best of each class, then those that are not in one component yet."""
        best = pending.groupBy("a").agg(F.max_by("b", F.struct("matches", "b")).alias("b"))
        self._confirm(frozen(best), sets, percent)
        rest = pending.join(best, ["a", "b"], "left_anti").select("a", "b")
        self._confirm(frozen(self.across(rest)), sets, percent)

    def _confirm(self, pairs: DataFrame, sets: DataFrame, percent: int) -> None:
        self.add(frozen(_confirmed(pairs, sets, percent)))

    def add(self, found: DataFrame) -> None:
        if found.limit(1).count():
            self.links = frozen(self.links.union(found))
            self.labels = connected(self.links)


def _open_lists(
    postings: DataFrame, labels: DataFrame, classes: DataFrame, shared: Broadcast, percent: int
) -> DataFrame:
    """`key`, `class`, `component`, `n`, `signature`: members of lists that are in several components
    and agree in MIN_MATCHES places, at sizes that allow a link, with one of another component.

    Of the lists that two classes share only that of the first place counts them.
    """
    placed = frozen(
        postings.join(labels, "class", "left").select(
            "key", "class", F.coalesce("component", "class").alias("component")
        )
    )
    split = frozen(
        placed.groupBy("key")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("component").alias("_lo"), F.max("component").alias("_hi"))
        .filter("_lo < _hi")
        .select("key", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks"))
    )
    spread = _in_blocks(lookup(placed, split, "key"))
    signed = spread.join(classes.select("class", "n", "signature"), "class")
    names = ["key", "class", "component", "n", "signature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, _BLOCKS):
            open_rows = np.zeros(table.num_rows, bool)
            for i, hit in _candidates(table, shared.value, percent):
                open_rows[i] |= len(hit) > 0
                open_rows[hit] = True
            found = table.select(names).filter(pa.array(open_rows)).combine_chunks()
            yield from found.to_batches()

    schema = "key long, class long, component long, n long, signature binary"
    found = (
        signed.repartition(*_BLOCKS).sortWithinPartitions(*_BLOCKS, "class").mapInArrow(run, schema)
    )
    return found.dropDuplicates(["key", "class"])


_BLOCKS = ["key", "_low", "_high"]


def _in_blocks(members: DataFrame) -> DataFrame:
    """Members of lists of `_blocks` blocks, once for each pair of blocks (`_low`, `_high`) with theirs."""
    dealt = members.withColumn("_block", F.pmod(F.xxhash64("class"), F.col("_blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    pairs = {"_low": F.least("_block", "_other"), "_high": F.greatest("_block", "_other")}
    return dealt.withColumn("_other", others).withColumns(pairs).drop("_blocks", "_other")


def _candidates(
    table: pa.Table, frequencies: np.ndarray, percent: int
) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows) of a table of whole pairs of blocks: which others each row may be linked to."""
    low, block, parts = (table.column(name).to_numpy() for name in ("_low", "_block", "component"))
    signs, sizes = _signatures(table.column("signature")), table.column("n").to_numpy()
    posted = _keys(signs)
    place_of = (posted == table.column("key").to_numpy().view(np.uint64)[:, None]).argmax(axis=1)
    inside_prefix = np.zeros(posted.shape, bool)
    np.put_along_axis(inside_prefix, _prefix(posted, frequencies), True, axis=1)
    for start, end in runs(table, _BLOCKS):
        inside = np.arange(start, end)
        one = inside[block[start:end] == low[start]]
        two = inside[block[start:end] != low[start]]
        for place, i in enumerate(one):
            rest = two if len(two) else one[place + 1 :]
            rest = rest[parts[rest] != parts[i]]
            small, large = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
            rest = rest[100 * small >= percent * large]
            equal = signs[rest] == signs[i]
            first = (equal & inside_prefix[rest] & inside_prefix[i]).argmax(axis=1)
            yield i, rest[(equal.sum(axis=1) >= MIN_MATCHES) & (first == place_of[i])]


def _links_between(
    open_lists: DataFrame, sets: DataFrame, shared: Broadcast, percent: int
) -> DataFrame:
    """Links (a, b) that join the components of `open_lists` as far as their members are linked.

    The members of a list meet block by block with their full sets. Blocks hold a bounded number of
    bytes, or one set: the size of a set decides, and not how many there are.
    """
    bytes_of = F.sum(F.col("n") * 6)
    blocks = frozen(
        open_lists.groupBy("key").agg(F.ceil(bytes_of / BLOCK_BYTES).cast("int").alias("_blocks"))
    )
    spread = _in_blocks(lookup(open_lists, blocks, "key")).join(sets, "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, _BLOCKS):
            classes = table.column("class").to_numpy()
            parts = table.column("component").to_pylist()
            forest, found = _Forest(), []
            members: dict[int, np.ndarray] = {}
            for i, hit in _candidates(table, shared.value, percent):
                rest = [j for j in hit.tolist() if forest.apart(parts[i], parts[j])]
                for j in [i, *rest] if rest else []:
                    if j not in members:
                        members[j] = _unpack(table.column("members")[j].as_py())
                for j in rest:
                    if forest.apart(parts[i], parts[j]) and _overlap(members[i], members[j], percent):
                        forest.join(parts[i], parts[j])
                        found.append((int(classes[i]), int(classes[j])))
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]
                )

    return (
        spread.repartition(*_BLOCKS)
        .sortWithinPartitions(*_BLOCKS, "class")
        .mapInArrow(run, "a long, b long")
    )


def _overlap(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets overlap enough."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    shared = int((large[at] == small).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


class _Forest:
    """Components joined inside one task."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def top(self, part: int) -> int:
        while (up := self.above.get(part, part)) != part:
            self.above[part] = self.above.get(up, up)
            part = up
        return part

    def apart(self, one: int, two: int) -> bool:
        return self.top(one) != self.top(two)

    def join(self, one: int, two: int) -> None:
        self.above[self.top(one)] = self.top(two)


def _with_components(
    rows: DataFrame, docs: DataFrame, shingle: int, percent: int, text_column: str
) -> DataFrame:
    """`rows`, as `_described` and written, with `_component` in place of class and signature: the
    least class of all that theirs is linked to; null without words."""
    classes = frozen(
        rows.filter("class is not null")
        .groupBy("class")
        .agg(F.first("n").alias("n"), F.first("signature").alias("signature"))
    )
    shared = docs.sparkSession.sparkContext.broadcast(_frequencies(classes))
    postings = frozen(_postings(classes, shared))
    ends = frozen(
        postings.groupBy("key")
        .agg(F.min("class").alias("_lo"), F.max("class").alias("_hi"))
        .filter("_lo < _hi")
    )
    stars = (
        lookup(postings, ends, "key")
        .select("class", F.explode(F.array("_lo", "_hi")).alias("_end"))
        .filter("class <> _end")
        .select(F.least("class", "_end").alias("a"), F.greatest("class", "_end").alias("b"))
        .distinct()
    )
    state = _Links(docs.sparkSession)
    pending = frozen(_matching(stars, classes))
    wanted = frozen(pending.select(F.col("a").alias("class")).union(pending.select("b")).distinct())
    state.resolve(pending, frozen(_sets(docs, wanted, shingle, text_column)), percent)

    open_lists = frozen(_open_lists(postings, state.labels, classes, shared, percent))
    wanted = frozen(open_lists.select("class").distinct())
    sets = frozen(_sets(docs, wanted, shingle, text_column))
    state.add(frozen(_links_between(open_lists, sets, shared, percent)))
    named = state.labels.withColumnRenamed("component", "_named")
    slim = rows.drop("signature")
    found = lookup(slim.filter("class is not null"), named, "class", "left").select(
        *slim.columns, F.coalesce("_named", "class").alias("_component")
    )
    wordless = slim.filter("class is null").withColumn("_component", F.lit(None).cast("long"))
    return frozen(found.unionByName(wordless).drop("class"))


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per row: the id, `n_shingles`, `component_id` (the least id it is linked to, directly or not),
    `kept` (whether that is its own id).

    Two texts are linked if 100 * shared >= percent * all of their distinct `shingle`-word shingles
    (words in lower-case ASCII; a text of fewer words is one shingle). `percent` must be 80 or more,
    for which the signature's threshold is chosen. A null text or one without words has no shingles
    and is linked with nothing. Rows that repeat an id are kept or not together. A null id is
    not a least id unless all ids of its component are null. Other columns are ignored, an empty
    table gives an empty result. Hashes of shingles have 48 bits, names of sets 64.
    """
    _check(percent)
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    described = frozen(_described(rows, shingle, ["_id"], "_text"))
    found = _with_components(described, docs, shingle, percent, text_column)
    linked = found.filter("_component is not null")
    least = frozen(linked.groupBy("_component").agg(F.min("_id").alias("_least")))
    wordless = found.filter("_component is null").withColumn("_least", F.col("_id"))
    component = F.col("_least")
    return lookup(linked, least, "_component").unionByName(wordless).select(
        F.col("_id").alias(id_column),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
    )


def _check(percent: int) -> None:
    if percent < PERCENT:
        raise ValueError(f"candidates are complete from {PERCENT} percent on")


def keep_one(
    docs: DataFrame,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row of each component of `near_duplicates`, all columns; rows without words all stay.

    It is the row with the least id, a null id after all others; of several rows with that id, also of
    equal ones, one stays. `docs` is written once with a number for each row, by which the others are
    dropped; the numbers are broadcast where they are few enough. Columns may have any names.
    """
    _check(percent)
    numbered = frozen(
        docs.select(
            F.monotonically_increasing_id().alias("_row"),
            F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("_doc"),
        )
    )
    doc = F.col("_doc")
    rows = numbered.select("_row", doc[id_column].alias("_id"), doc[text_column].alias("_text"))
    described = frozen(_described(rows, shingle, ["_row", "_id"], "_text"))
    found = _with_components(described, rows, shingle, percent, "_text").filter(
        "_component is not null"
    )
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row"))
    stay = found.groupBy("_component").agg(first.alias("_first")).select(
        F.col("_first._row").alias("_row")
    )
    gone = frozen(found.select("_row").join(stay, "_row", "left_anti"))
    dropped = F.broadcast(gone) if fits(gone, BROADCAST_CLASSES) else gone
    return numbered.join(dropped, "_row", "left_anti").select(
        *[doc[name].alias(name) for name in docs.columns]
    )
