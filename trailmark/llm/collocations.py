"""Phrase collocations, counted in a prefix-free parse.

Prefix-free parsing: a text's words and piece ends form one sequence. Wherever the hash of the next
`window` entries is a multiple of PERIOD a chunk begins, and the chunk before reaches `window` entries
into it (the longest phrase has one word more). Equal content is cut equally wherever it stands, so
copies, boilerplate and quoted passages become the same chunks. The dictionary holds each distinct
chunk once, with its frequency in the parse; phrases are counted inside distinct chunks, weighted by
it. A phrase belongs to the chunk in which it begins before the overlap, so each occurrence counts once.

Counts go by length: a phrase is only counted where both its parts one word shorter occur often
enough, which tasks look up in bitmaps of bounded size. A bit that another phrase has set lets a rare
phrase through, which the exact count then removes; no frequent one is lost.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from trailmark.llm.keyed import framed, lookup, name_of
from trailmark.llm.words import chunks, hashes, window_hashes
from trailmark.operators.freeze import frozen

# Entries between the beginnings of chunks: on average, and at most.
PERIOD = 32
LONGEST_CHUNK = 512
# Bytes of one text that are parsed at once, and characters of texts or chunks that are.
SEGMENT_BYTES = 4_000_000
BATCH_CHARS = 8_000_000
# Bits of a bitmap per phrase, and in all (32 MB).
BITS_PER_PHRASE = 64
MOST_BITS = 1 << 28

# Fixed values of the contract: A-Z become a-z, these characters end a piece, `und` stands for null.
_PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
UNKNOWN = "und"
# A byte that UTF-8 does not have, and the entry that stands for it in a chunk.
_END = b"\xff"
_LINE = b"\n"
_TABLE = bytes.maketrans(
    bytes(range(65, 91)) + _PIECE_ENDS, bytes(range(97, 123)) + _END * len(_PIECE_ENDS)
)
_ENDS = re.compile(rb"\xff[ \t\xff]*")
_BLANK = re.compile(rb"[ \t]")


def chunk_dictionary(
    docs: DataFrame, max_words: int = 3, text_column: str = "text", lang_column: str = "lang"
) -> DataFrame:
    """The distinct chunks of all texts: `lang`, `chunk`, `overlap`, `freq`, written.

    A chunk is its words joined by spaces, with a line feed in place of piece ends. Its last `overlap`
    entries also begin the next chunk. Null texts are empty; a null language is `und`.
    """
    texts = docs.select(
        F.coalesce(F.col(lang_column).cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.col(text_column).cast("string").alias("text"),
    ).filter("text is not null")
    parse = functools.partial(_parsed, window=max(1, max_words - 1))
    parsed = texts.mapInArrow(parse, "lang string, chunk string, overlap int, freq long")
    return frozen(parsed.groupBy("lang", "chunk", "overlap").agg(F.sum("freq").alias("freq")))


def _segments(text: str) -> Iterator[bytes]:
    """The text in lower case, runs of piece ends as one entry, cut between words."""
    raw = text.encode("utf-8", "surrogatepass").translate(_TABLE)
    at = 0
    while len(raw) - at > SEGMENT_BYTES and (cut := _BLANK.search(raw, at + SEGMENT_BYTES)):
        yield _ENDS.sub(b" \xff ", raw[at : cut.start()])
        at = cut.start()
    yield _ENDS.sub(b" \xff ", raw[at:] if at else raw)


def _chunks_of(text: str, window: int) -> Iterator[tuple[bytes, int]]:
    """(chunk, overlap) along one text; entries after the last beginning are carried on."""
    carried: list[bytes] = []
    for segment in _segments(text):
        entries = carried + segment.split()
        of_windows = window_hashes(hashes(entries), window)
        begins = np.flatnonzero(of_windows % np.uint64(PERIOD) == 0).tolist()
        start, last = 0, len(entries) - window
        for begin in [*begins, last]:
            while begin - start > LONGEST_CHUNK:
                yield b" ".join(entries[start : start + LONGEST_CHUNK + window]), window
                start += LONGEST_CHUNK
            if start < begin < last:
                yield b" ".join(entries[start : begin + window]), window
                start = begin
        carried = entries[start:]
    if carried:
        yield b" ".join(carried), 0


def _parsed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text", BATCH_CHARS):
        found: Counter = Counter()
        held = 0
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            for chunk, overlap in _chunks_of(text, window):
                found[lang, chunk, overlap] += 1
                held += len(chunk)
                if held > 4 * BATCH_CHARS:
                    yield _chunk_rows(found)
                    found, held = Counter(), 0
        yield _chunk_rows(found)


def _chunk_rows(found: Counter) -> pa.RecordBatch:
    langs, texts, overlaps = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(langs, pa.string()),
            pa.array([text.replace(_END, _LINE) for text in texts], pa.binary()).cast(pa.string()),
            pa.array(overlaps, pa.int32()),
            pa.array(list(found.values()), pa.int64()),
        ],
        ["lang", "chunk", "overlap", "freq"],
    )


def phrase_counts(dictionary: DataFrame, max_words: int, min_count: int) -> list[DataFrame]:
    """For each length from 1 the phrases with `min_count` occurrences at least: `lang`, `phrase`, `f`.

    The first table also has, as the empty phrase, the number of all words of each language.
    """
    counts: list[DataFrame] = []
    maps: list[Broadcast] = []
    for words in range(1, max_words + 1):
        if counts:
            maps.append(_bitmap(counts[-1].filter("phrase != ''")))
        counted = functools.partial(_counted, words=words, maps=list(maps))
        summed = (
            dictionary.mapInArrow(counted, "lang string, phrase string, f long")
            .groupBy("lang", "phrase")
            .agg(F.sum("f").alias("f"))
        )
        counts.append(frozen(summed.filter((F.col("f") >= min_count) | (F.col("phrase") == ""))))
    for sent in maps:
        sent.destroy()
    return counts


def _word_hashes(lang: str, words: list[str]) -> np.ndarray:
    """64 bits for each word of a language."""
    front = lang.encode("utf-8", "surrogatepass") + b"\0"
    found = (xxh3_64_intdigest(front + word.encode("utf-8", "surrogatepass")) for word in words)
    return np.fromiter(found, np.uint64, len(words))


def _bitmap(phrases: DataFrame) -> Broadcast:
    """A bit for the hash of each phrase, in MOST_BITS bits at most."""
    bits = min(MOST_BITS, 1 << max(6, (phrases.count() * BITS_PER_PHRASE).bit_length()))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = (batch.column(name).to_pylist() for name in ("lang", "phrase"))
            found = np.zeros(batch.num_rows, np.uint64)
            for i, (lang, text) in enumerate(zip(langs, texts)):
                words = text.split(" ")
                found[i] = window_hashes(_word_hashes(lang, words), len(words))[0]
            found &= np.uint64(bits - 1)
            bit = np.uint64(1) << (found & np.uint64(63))
            columns = [(found >> np.uint64(6)).astype(np.int64), bit.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cell", "bits"])

    # At most MOST_BITS / 64 rows.
    filled = phrases.mapInArrow(cells, "cell long, bits long").groupBy("cell")
    table = filled.agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[table.column("cell").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return phrases.sparkSession.sparkContext.broadcast(bitmap)


def _among(bitmap: np.ndarray, found: np.ndarray) -> np.ndarray:
    at = found & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _counted(batches, words: int, maps: list[Broadcast]) -> Iterator[pa.RecordBatch]:
    """Phrases of so many `words` in distinct chunks, weighted; `maps` are of the shorter lengths."""
    for batch in chunks(batches, "chunk", BATCH_CHARS):
        langs = batch.column("lang").dictionary_encode()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            mine = batch.filter(pc.equal(langs.indices, i))
            phrases, counts = _weighted(lang, mine, words, [sent.value for sent in maps])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang], pa.string()).take(pa.array(np.zeros(len(counts), np.int64))),
                    phrases,
                    pa.array(counts),
                ],
                ["lang", "phrase", "f"],
            )


def _weighted(lang: str, batch: pa.RecordBatch, words: int, maps: list[np.ndarray]):
    entries = pc.split_pattern(batch.column("chunk"), " ")
    coded = entries.flatten().dictionary_encode()
    of_entry = coded.indices.to_numpy().astype(np.int64)
    texts = coded.dictionary
    is_word = np.asarray(pc.not_equal(texts, "\n"))
    sizes = pc.list_value_length(entries).to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    begins = place < np.repeat(sizes - batch.column("overlap").to_numpy(), sizes)
    freq = batch.column("freq").to_numpy()

    alive = is_word[of_entry]
    hashed = _word_hashes(lang, texts.to_pylist())[of_entry] if maps else None
    for length in range(2, words + 1):
        often = alive & _padded(_among(maps[length - 2], window_hashes(hashed, length - 1)), len(row))
        alive = _padded(often[:-1] & often[1:] & (row[:-1] == row[1:]), len(row))
    at = np.flatnonzero(alive & begins)
    # Dense numbers of the phrases, exact whatever the words.
    number = of_entry[at]
    for further in range(1, words):
        number = number * len(texts) + of_entry[at + further]
        number = np.unique(number, return_inverse=True)[1]
    distinct, first, number = np.unique(number, return_index=True, return_inverse=True)
    counts = np.zeros(len(distinct), np.int64)
    np.add.at(counts, number, freq[row[at]])
    parts = [texts.take(pa.array(of_entry[at[first] + i])) for i in range(words)]
    phrases = pc.binary_join_element_wise(*parts, " ") if words > 1 else parts[0]
    if words == 1:
        phrases = pa.concat_arrays([phrases, pa.array([""], pa.string())])
        counts = np.append(counts, counts.sum())
    return phrases, counts


def _padded(flags: np.ndarray, size: int) -> np.ndarray:
    return np.concatenate([flags, np.zeros(size - len(flags), bool)])


def collocations(
    docs: DataFrame,
    max_words: int = 3,
    min_count: int = 10,
    absorbed_percent: int = 50,
    top: int = 2000,
    text_column: str = "text",
    lang_column: str = "lang",
) -> DataFrame:
    """The phrases of 2 to `max_words` words that hold together best, `top` per language.

    Texts are put in lower case (A-Z only) and split into pieces at `.,;:!?` and \\x0A-\\x0D, pieces into
    words at spaces and tabs. Candidates are phrases inside pieces with `min_count` occurrences `a` at
    least, overlapping ones included. A cut after the first words gives the occurrences `l` and `r` of
    its parts and floor(10**6 * a * a / (l * r)); the lowest-scoring cut counts, of equal ones the
    first. Phrases inside a longer candidate that occurs `absorbed_percent` of their times at least are
    dropped. Returned are `lang`, `rank`, `phrase`, `a`, `l`, `r`, `n` (all words of the language),
    `score`; ranks go by score and `a`, descending, then by phrase in byte order.

    Counts cover all rows, repeated ones too, and all languages; a null text is empty, a null language
    is `und`. Of `docs` only the two columns are read. No rows give no rows.
    """
    dictionary = chunk_dictionary(docs, max_words, text_column, lang_column)
    counts = phrase_counts(dictionary, max_words, min_count)
    key = name_of(framed(F.col("lang")), F.col("phrase")).alias("key")
    phrases = functools.reduce(DataFrame.unionByName, counts).filter("phrase != ''")
    phrases = frozen(phrases.select("lang", "phrase", "f", key))
    words = F.split("phrase", " ")
    candidates = phrases.withColumn("words", words).filter(F.size("words") > 1)
    kept = candidates.join(_longer(candidates), "key", "left").filter(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("f") * absorbed_percent)
    )
    parts = phrases.select(F.col("key").alias("part"), F.col("f").alias("times"))
    best = _lowest_cuts(kept, parts)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # Not cast before the filter: so each task keeps `top` rows of a language before the shuffle.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    ranked = best.withColumn("rank", rank).filter(F.col("rank") <= top)
    totals = counts[0].filter("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def _longer(candidates: DataFrame) -> DataFrame:
    """Per `key` of a phrase the occurrences of the most frequent candidate that holds it inside."""
    size = F.size("words")
    inner = candidates.filter(size > 2).select(
        "lang", "words", "f", F.explode(F.sequence(F.lit(2), size - 1)).alias("length")
    )
    start = F.explode(F.sequence(F.lit(1), size - F.col("length") + 1))
    held = inner.withColumn("start", start).select(
        "f",
        name_of(
            framed(F.col("lang")),
            F.array_join(F.slice("words", F.col("start"), F.col("length")), " "),
        ).alias("key"),
    )
    return held.groupBy("key").agg(F.max("f").alias("longer"))


def _lowest_cuts(kept: DataFrame, parts: DataFrame) -> DataFrame:
    """`lang`, `phrase`, `a`, and the `l`, `r` and `score` of the lowest-scoring cut."""
    size = F.size("words")
    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), size - 1)))

    def part(start, length):
        text = F.array_join(F.slice("words", start, length), " ")
        return name_of(framed(F.col("lang")), text)

    named = frozen(
        cuts.select(
            "lang",
            "phrase",
            F.col("f").alias("a"),
            "cut",
            part(F.lit(1), F.col("cut")).alias("first"),
            part(F.col("cut") + 1, size - F.col("cut")).alias("rest"),
        )
    )
    lefts = parts.withColumnsRenamed({"part": "first", "times": "l"})
    rights = parts.withColumnsRenamed({"part": "rest", "times": "r"})
    counted = lookup(frozen(lookup(named, lefts, "first")), rights, "rest")
    # Whole numbers of 38 digits: exact up to some 10**16 words.
    big = {name: F.col(name).cast("decimal(38,0)") for name in ("a", "l", "r")}
    scored = counted.withColumns({f"_{name}": column for name, column in big.items()}).withColumn(
        "score", F.expr("(cast(1000000 as decimal(38,0)) * _a * _a) div (_l * _r)").cast("long")
    )
    lowest = F.min(F.struct("score", "cut", "l", "r")).alias("low")
    return scored.groupBy("lang", "phrase", "a").agg(lowest).select(
        "lang", "phrase", "a", "low.l", "low.r", "low.score"
    )
