"""Interpolated modified Kneser-Ney models of characters, one per language.

A sequence of symbols is a start mark, code points, an end mark: each word by itself, or, with
`running`, the whole text, its words joined by one space. The probability of a symbol is conditioned on
the ORDER - 1 symbols before it in its sequence, which in a running text reach into the words before.

Tasks hash the n-gram of every symbol of a chunk of text at once. Counting and all estimates are
DataFrame joins and aggregations over distinct n-grams, hash-partitioned by n-gram; what a task holds
is a chunk and the distinct n-grams of some chunks. The result, a table of the log probability of every distinct
n-gram that the scored texts contain, is read as sorted arrays of hashes where it is small, and joined
with the n-grams of the texts by shuffle beyond that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.words import chunks, hashes, mixed, words_of
from trailmark.operators.freeze import frozen

ORDER = 4
START, END = "\x02", "\x03"

# Entries of the table that are broadcast as arrays, 12 bytes each; n-grams a task remembers; text
# handled at once inside a task, in code points.
ARRAY_ENTRIES = 4_000_000
TASK_GRAMS = 200_000
CHUNK_CHARS = 1_000_000

_GRAMS = "lang string, gram string, key long, n long, n_0 long"
_PARTS = "_row_id string, _row_digest long, key long, n long"


_MARKS = str.maketrans({START: "\x1a", END: "\x1a"})
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _sequences(text: str | None, running: bool) -> str:
    """The sequences of a text, marked, one after another; empty without words."""
    words = words_of(text)
    if not words:
        return ""
    plain = b" ".join(words).decode("utf-8", "surrogatepass")
    if START in plain or END in plain:
        plain = plain.translate(_MARKS)
    return f"{START}{plain if running else plain.replace(' ', END + START)}{END}"


def _keys(text: str, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each start mark in sequences, and a key of the n-gram that ends at each symbol, the
    longest up to `order` that lies in its sequence. What ends at a start mark is no n-gram."""
    symbols = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.flatnonzero(symbols == ord(START))
    earlier = symbols.astype(np.uint64) + np.uint64(1)
    key = earlier.copy()
    for _ in range(1, order):
        # Before the first symbol of a sequence there are zeros.
        earlier[1:] = earlier[:-1]
        earlier[starts] = 0
        key *= _BASE
        key += earlier
    return starts, key


def _lots(texts: list[str], order: int) -> Iterator[tuple[str, np.ndarray, int]]:
    """The sequences of all texts in strings that a task can hold, the text of each symbol, and how many
    symbols at the start are only there as those before others.

    Short texts are taken together, a long one by itself in pieces, so that it is cut alike in any company.
    """
    short = [row for row, text in enumerate(texts) if len(text) <= CHUNK_CHARS]
    together = [texts[row] for row in short]
    if any(together):
        yield "".join(together), np.repeat(short, list(map(len, together))), 0
    for row, text in enumerate(texts):
        for start in range(0, len(text) if len(text) > CHUNK_CHARS else 0, CHUNK_CHARS):
            before = max(start - order + 1, 0)
            piece = text[before : start + CHUNK_CHARS]
            yield piece, np.full(len(piece), row), start - before


def _counted_once(key: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """A place of each distinct key, and the sums of whole numbers, the weights, at the places of the key."""
    place = np.argsort(key)
    ordered = key[place]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return place[first], *[np.add.reduceat(weight[place], first) for weight in weights]


def _salted(key: np.ndarray, lang: str) -> np.ndarray:
    """Keys of n-grams of one language."""
    return mixed(key ^ hashes([lang.encode("utf-8", "surrogatepass")])[0])


def _lang(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


class _Grams:
    """The distinct n-grams of texts of one language, and how often trained rows have them, in all and in
    those of fold 0."""

    def __init__(self) -> None:
        self.keys, self.n, self.n_0 = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.grams = np.zeros(0, object)

    def add(self, texts: list[str], trained: np.ndarray, fold: np.ndarray, order: int) -> None:
        n, n_0 = trained.astype(np.int64), (trained & (fold == 0)).astype(np.int64)
        for text, row, skip in _lots(texts, order):
            self._add(text, [n[row], n_0[row]], skip, order)

    def _add(self, text: str, weights: list[np.ndarray], skip: int, order: int) -> None:
        starts, key = _keys(text, order)
        scored = np.ones(len(key), bool)
        scored[starts] = False
        scored[:skip] = False
        at = np.flatnonzero(scored)
        place, *sums = _counted_once(key[at], [weight[at] for weight in weights])
        key, at = key[at[place]], at[place]
        # Those known are added up, the others written out.
        held = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        known = self.keys[held] == key if len(self.keys) else np.zeros(len(key), bool)
        self.n[held[known]] += sums[0][known]
        self.n_0[held[known]] += sums[1][known]
        new = np.flatnonzero(~known)
        at = at[new]
        begin = np.maximum(at - order + 1, np.append(0, starts)[np.searchsorted(starts, at)])
        grams = np.empty(len(new), object)
        grams[:] = [text[i : j + 1] for i, j in zip(begin.tolist(), at.tolist())]
        keys = np.concatenate([self.keys, key[new]])
        order_ = np.argsort(keys)
        self.keys = keys[order_]
        self.grams = np.concatenate([self.grams, grams])[order_]
        self.n = np.concatenate([self.n, sums[0][new]])[order_]
        self.n_0 = np.concatenate([self.n_0, sums[1][new]])[order_]

    def rows(self, lang: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(self.keys), pa.string()),
                pa.array(self.grams, pa.string()),
                pa.array(_salted(mixed(self.keys), lang).view(np.int64)),
                pa.array(self.n),
                pa.array(self.n_0),
            ],
            names=["lang", "gram", "key", "n", "n_0"],
        )


def _of_languages(langs: list[str]) -> Iterator[tuple[str, list[int]]]:
    """Each language and the places it has in `langs`."""
    places: dict[str, list[int]] = {}
    for place, lang in enumerate(langs):
        places.setdefault(lang, []).append(place)
    yield from places.items()


def _count_grams(order: int, running: bool) -> Callable:
    """For mapInArrow over (`_lang`, `_text`, `_train`, `_fold`): the n-grams of each task, with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Grams] = {}
        for chunk in chunks(batches, "_text", CHUNK_CHARS):
            texts = [_sequences(text, running) for text in chunk.column("_text").to_pylist()]
            trained = np.array(chunk.column("_train").to_pylist(), bool)
            fold = np.array(chunk.column("_fold").to_pylist(), np.int64)
            for lang, rows in _of_languages(chunk.column("_lang").to_pylist()):
                grams = held.setdefault(lang, _Grams())
                grams.add([texts[row] for row in rows], trained[rows], fold[rows], order)
            if sum(len(grams.keys) for grams in held.values()) > TASK_GRAMS:
                yield from (grams.rows(lang) for lang, grams in held.items())
                held = {}
        yield from (grams.rows(lang) for lang, grams in held.items())

    return run


def _discounts(level: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts of a level, per language; fixed ones where counts lack."""
    stats = level.groupBy("lang").agg(
        *[F.count(F.when(F.col("a") == i, 1)).cast("double").alias(f"n{i}") for i in range(1, 5)]
    )
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    known = F.least("n1", "n2", "n3", "n4") > 0
    return stats.select(
        "lang",
        *[
            F.when(
                known,
                F.greatest(F.lit(0.05), F.lit(float(i)) - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")),
            )
            .otherwise(F.lit(i * 0.5))
            .alias(f"d{i}")
            for i in (1, 2, 3)
        ],
    )


def log_probabilities(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """`key`, `logp` of every distinct n-gram of `grams` (lang, gram, key, n; n = 0 if only scored).

    The highest order and what begins with the start mark count tokens, lower orders distinct left
    neighbours. A language without any count gives all symbols the same probability.
    """
    counted = grams.filter("n > 0")
    longest = F.length("gram")
    starting = counted.filter(F.col("gram").startswith(START)).select(
        "lang", "gram", F.col("n").alias("a"), longest.alias("_size")
    )
    levels = {
        order: frozen(counted.filter(longest == order).select("lang", "gram", F.col("n").alias("a")))
    }
    needed = {order: grams.filter(longest == order).select("lang", "gram")}
    suffix = F.substring("gram", 2, order)
    for size in range(order - 1, 0, -1):
        below = levels[size + 1].groupBy("lang", suffix.alias("gram")).agg(F.count(F.lit(1)).alias("a"))
        raw = starting.filter(F.col("_size") == size).drop("_size")
        levels[size] = frozen(below.unionByName(raw))
        own = grams.filter((longest == size) & F.col("gram").startswith(START)).select("lang", "gram")
        needed[size] = needed[size + 1].select("lang", suffix.alias("gram")).union(own).distinct()

    probability = None
    for size in range(1, order + 1):
        level = levels[size].join(F.broadcast(_discounts(levels[size])), "lang")
        discount = (
            F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3"))
        )
        level = level.withColumn("_off", F.least(discount, F.col("a").cast("double")))
        context = F.substring("gram", 1, size - 1) if size > 1 else F.lit("")
        contexts = level.groupBy("lang", context.alias("_context")).agg(
            F.sum("a").alias("_all"), F.sum("_off").alias("_free"), F.count(F.lit(1)).alias("_kinds")
        )
        wanted = needed[size].select(
            "lang", "gram", context.alias("_context"), F.substring("gram", 2, order).alias("_suffix")
        )
        joined = wanted.join(
            level.select("lang", "gram", (F.col("a") - F.col("_off")).alias("_mass")),
            ["lang", "gram"],
            "left",
        ).join(contexts, ["lang", "_context"], "left")
        if probability is None:
            lower = 1.0 / (F.coalesce("_kinds", F.lit(0)) + 1)
        else:
            shorter = probability.select("lang", F.col("gram").alias("_suffix"), F.col("p").alias("_lower"))
            joined = joined.join(shorter, ["lang", "_suffix"])
            lower = F.col("_lower")
        p = F.when(F.col("_all").isNull(), lower).otherwise(
            (F.coalesce("_mass", F.lit(0.0)) + F.col("_free") * lower) / F.col("_all")
        )
        if size == order:
            kept = joined
            break
        probability = frozen(joined.select("lang", "gram", p.alias("p")))
        short = probability.filter(F.col("gram").startswith(START))
        found = short if size == 1 else found.unionByName(short)
    found = found.unionByName(kept.select("lang", "gram", p.alias("p")))
    return (
        grams.select("lang", "gram", "key")
        .join(found, ["lang", "gram"])
        .select("key", F.log("p").cast("float").alias("logp"))
    )


class Model:
    """Log probabilities of the n-grams of a set of texts, and their use on these texts."""

    def __init__(self, table: DataFrame, order: int, array_entries: int, running: bool) -> None:
        self.table = frozen(table.repartitionByRange("key").sortWithinPartitions("key"))
        self.order, self.running = order, running
        self.arrays = None
        if self.table.limit(array_entries + 1).count() <= array_entries:
            pieces = self.table.toArrow()
            key = pieces["key"].to_numpy().view(np.uint64)
            logp = pieces["logp"].to_numpy()
            place = np.argsort(key)
            context = table.sparkSession.sparkContext
            self.arrays = context.broadcast((key[place], logp[place]))

    def scores(self) -> Callable | None:
        """A function for tasks: the log probability of each (language, text); None if the model
        is too large for it."""
        arrays, order, running = self.arrays, self.order, self.running
        if arrays is None:
            return None
        index: list[np.ndarray] = []

        def score(langs: list[str], texts: list[str | None]) -> list[float]:
            keys, logp = arrays.value
            if not index:
                index.append(_first_places(keys))
            total = np.zeros(len(texts))
            for lang, rows in _of_languages(langs):
                sequences = [_sequences(texts[row], running) for row in rows]
                for text, row, skip in _lots(sequences, order):
                    starts, key = _keys(text, order)
                    values = logp[_found(keys, index[0], _salted(mixed(key), lang))]
                    values[starts] = 0
                    values[:skip] = 0
                    # Added text by text, so that the last digits do not depend on the other rows.
                    total[rows] += np.bincount(row, weights=values, minlength=len(rows))
            return total.tolist()

        return score


# Leading bits of a key by which its place among the sorted keys of a model is looked up.
_INDEX_BITS = 20


def _first_places(keys: np.ndarray) -> np.ndarray:
    """For each value of the leading bits the place of the first key that is not below them."""
    heads = np.arange(1 << _INDEX_BITS, dtype=np.uint64) << np.uint64(64 - _INDEX_BITS)
    return np.searchsorted(keys, heads).astype(np.int32)


def _found(keys: np.ndarray, places: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place among sorted `keys` of the first that is not below the wanted one, the last if none is."""
    last = len(keys) - 1
    at = np.minimum(places[(wanted >> np.uint64(64 - _INDEX_BITS)).astype(np.int64)], last)
    below = np.flatnonzero(keys[at] < wanted)
    while len(below):
        at[below] += 1
        below = below[at[below] <= last]
        below = below[keys[at[below]] < wanted[below]]
    return np.minimum(at, last)


def _facts(found: Callable, names: list[str], texts: list[str | None]) -> list[pa.Array]:
    rows = [found(text) for text in texts]
    return [pa.array(x, pa.int64()) for x in zip(*rows)] or [pa.array([], pa.int64()) for _ in names]


def scored(
    docs: DataFrame,
    columns: list[Column],
    model: Model,
    facts: Callable[[str | None], tuple],
    names: list[str],
    id_column: str,
    text_column: str,
    lang_column: str,
) -> DataFrame:
    """`columns` packed as `_row`, `_lang`, `facts` of each text and `log_ppl`, null without words.

    `facts` gives the long columns `names`, of which the first two are the words and the code points
    in words; log perplexity is per code point and word end.
    """
    score = model.scores()
    rows = docs.select(
        F.struct(*columns).alias("_row"),
        F.col(id_column).cast("string").alias("_id"),
        F.xxhash64(_lang(lang_column), F.col(text_column)).alias("_digest"),
        _lang(lang_column).alias("_lang"),
        F.col(text_column).alias("_text"),
    )
    if score is not None:
        rows = rows.drop("_id", "_digest")
    carried = [name for name in rows.columns if name != "_text"]
    fields = [rows.schema[name] for name in carried]
    fields += [T.StructField(name, T.LongType()) for name in names]
    if score is not None:
        fields.append(T.StructField("log_ppl", T.DoubleType()))
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "_text", CHUNK_CHARS):
            texts = chunk.column("_text").to_pylist()
            found = _facts(facts, names, texts)
            arrays = [*map(chunk.column, carried), *found]
            if score is not None:
                totals = score(chunk.column("_lang").to_pylist(), texts)
                sizes = (found[0].to_numpy() + found[1].to_numpy()).tolist()
                arrays.append(
                    pa.array([-x / n if n else None for x, n in zip(totals, sizes)], pa.float64())
                )
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    done = rows.mapInArrow(run, schema)
    if score is not None:
        return done
    # The model is too large to be held in a task: join the n-grams of the distinct rows with it.
    totals = _joined_totals(rows, model)
    same = done["_id"].eqNullSafe(totals["_row_id"]) & (done["_digest"] == totals["_row_digest"])
    sizes = F.col(names[0]) + F.col(names[1])
    return done.join(totals, same, "left").select(
        "_row", "_lang", *names, (-F.col("_logp") / sizes).alias("log_ppl")
    )


def _joined_totals(rows: DataFrame, model: Model) -> DataFrame:
    """`_row_id`, `_row_digest` and `_logp` of each distinct row with words."""
    order, running = model.order, model.running

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "_text", CHUNK_CHARS):
            columns = (chunk.column(n).to_pylist() for n in ("_id", "_digest", "_lang", "_text"))
            for row, digest, lang, text in zip(*columns):
                sequences = _sequences(text, running)
                if not sequences:
                    continue
                starts, key = _keys(sequences, order)
                key, n = np.unique(_salted(mixed(np.delete(key, starts)), lang), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row] * len(key), pa.string()),
                        pa.array([digest] * len(key), pa.int64()),
                        pa.array(key.view(np.int64)),
                        pa.array(n),
                    ],
                    names=["_row_id", "_row_digest", "key", "n"],
                )

    distinct = rows.select("_id", "_digest", "_lang", "_text").dropDuplicates(["_id", "_digest"])
    return (
        distinct.mapInArrow(parts, _PARTS)
        .join(model.table, "key")
        .groupBy("_row_id", "_row_digest")
        .agg(F.sum(F.col("n") * F.col("logp")).alias("_logp"))
    )


def _counted(
    docs: DataFrame,
    trained: Column,
    fold: Column,
    text_column: str,
    lang_column: str,
    order: int,
    running: bool,
) -> DataFrame:
    """The distinct n-grams of `docs`: lang, gram, key, how often they occur in trained rows, `n`, and in
    those of fold 0, `n_0`."""
    rows = docs.select(
        _lang(lang_column).alias("_lang"),
        F.col(text_column).alias("_text"),
        F.coalesce(trained, F.lit(False)).alias("_train"),
        fold.cast("int").alias("_fold"),
    )
    return frozen(
        rows.mapInArrow(_count_grams(order, running), _GRAMS)
        .groupBy("lang", "gram")
        .agg(
            F.first("key").alias("key"),
            F.sum("n").alias("n"),
            F.sum("n_0").alias("n_0"),
        )
    )


def train(
    docs: DataFrame,
    trained: Column,
    text_column: str = "text",
    lang_column: str = "lang",
    order: int = ORDER,
    array_entries: int = ARRAY_ENTRIES,
    running: bool = False,
) -> Model:
    """A model of each language from the rows where `trained` holds, for scoring all rows of `docs`.

    Its n-grams lie in words, or, if `running`, in texts, across their words; these take an `order` of 2
    at least.
    A null language is a language of its own, the same as the empty string. Null texts have no words.
    """
    grams = _counted(docs, trained, F.lit(0), text_column, lang_column, order, running)
    return Model(log_probabilities(grams.drop("n_0"), order), order, array_entries, running)


def train_crossed(
    docs: DataFrame,
    trained: Column,
    fold: Column,
    text_column: str = "text",
    lang_column: str = "lang",
    order: int = ORDER,
    array_entries: int = ARRAY_ENTRIES,
    running: bool = False,
) -> tuple[Model, list[Model]]:
    """As `train`, and two models of half the trained rows, to score the others among these.

    `fold`, 0 or 1, divides the rows. The first half model has seen none of fold 0, the second none of
    fold 1; both are for trained rows only. The texts are counted once for all three.
    """
    grams = _counted(docs, trained, fold, text_column, lang_column, order, running)
    whole = Model(log_probabilities(grams.drop("n_0"), order), order, array_entries, running)
    seen = grams.filter("n > 0")
    halves = [seen.withColumn("n", n).drop("n_0") for n in (F.col("n") - F.col("n_0"), F.col("n_0"))]
    return whole, [
        Model(log_probabilities(half, order), order, array_entries, running) for half in halves
    ]
