"""Collocations, top-k search and prefix tries against plain versions, on edge cases and real rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from trailmark.llm import collocations, keyed, prefixtrie, topk
from trailmark.llm.queries import QUERIES


def found(df, *columns):
    return sorted((tuple(row) for row in (df.select(*columns) if columns else df).collect()), key=repr)


# 11

DOCS = "lang string, text string, phrase string, key long, freq string, chunk long, n string"


def docs_table(spark, rows):
    return spark.createDataFrame([(*row, "p", 1, "f", 2, "n") for row in rows], DOCS)


def phrase_rows():
    pick = random.Random(5)
    names = ["Ab", "b", "ß", "dé", "e", "ÀB", "f\x85g", "h"]
    rows = [("en", " ".join(pick.choices(names, k=pick.randint(0, 90)))) for _ in range(60)]
    rows += [("en", "x y z. " * 40), ("en", "Of of OF\tof  of"), (None, "no lang here " * 12)]
    rows += [("und", "no lang here"), ("de", None), ("de", ""), (None, None), ("fr", " ,;\n\v . ")]
    rows += [("en", "one,two one two;one\x0ctwo one!two ") for _ in range(9)] * 2
    return rows + [("de", "a " * 3000 + "b"), ("de", "a " * 3000 + "b")]


def test_collocations(spark):
    rows = phrase_rows()
    got = collocations.collocations(docs_table(spark, rows))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert found(got) == brute.collocations(rows)
    assert collocations.collocations(docs_table(spark, [])).count() == 0
    best = collocations.collocations(docs_table(spark, rows), max_words=4, min_count=5, top=7)
    assert found(best) == brute.collocations(rows, min_count=5, top=7, max_words=4)


def test_parse_is_whole(spark, monkeypatch):
    """Every cut of texts, segments and bitmaps gives the same phrases."""
    rows = phrase_rows()
    for name, value in (("PERIOD", 2), ("LONGEST_CHUNK", 3), ("SEGMENT_BYTES", 50)):
        monkeypatch.setattr(collocations, name, value)
    text = "Mm nn.. oo " * 30 + "pp"
    parsed = list(collocations._chunks_of(text, 2))
    assert max(len(chunk.split()) - overlap for chunk, overlap in parsed) <= 6
    again = [e for chunk, overlap in parsed for e in chunk.split()[: len(chunk.split()) - overlap]]
    assert again == ([b"mm", b"nn", b"\xff", b"oo"] * 30 + [b"pp"])
    dictionary = collocations.chunk_dictionary(docs_table(spark, rows), 3)
    monkeypatch.setattr(collocations, "MOST_BITS", 64)  # every bit may be set
    counts = collocations.phrase_counts(dictionary, 3, 10)
    loose = {tuple(row) for table in counts for row in found(table)}
    assert {(lang, phrase, a) for lang, _, phrase, a, *_ in brute.collocations(rows)} <= loose
    assert sum(row[2] for row in found(counts[0]) if row[1] == "") == sum(
        len(words) for words in _pieces(rows)
    )


def _pieces(rows):
    import re

    for _, text in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text or ""):
            yield re.findall(r"[^\x20\x09]+", piece)


def test_copies_share_chunks(spark):
    """A passage is cut alike in every text that holds it."""
    words = [f"w{(i * 7919 + i * i * 31) % 10007}" for i in range(2000)]
    rows = [("en", f"{i} start {' '.join(words)} end {i}") for i in range(50)]
    dictionary = collocations.chunk_dictionary(docs_table(spark, rows), 3)
    shared = dictionary.filter("freq >= 50").agg(F.sum(F.size(F.split("chunk", " ")))).first()[0]
    assert shared > 1500 and dictionary.filter("freq < 50").count() <= 100 + 10


def test_scores_beyond_64_bits(spark):
    key = "lang string, phrase string, f long, key binary, words array<string>"
    a = 3 * 10**12
    kept = spark.createDataFrame([("en", "p q", a, b"k", ["p", "q"])], key)
    one, two = (keyed.name_of(keyed.framed(F.lit("en")), F.lit(x)) for x in "pq")
    parts = spark.range(2).select(
        F.when(F.col("id") == 0, one).otherwise(two).alias("part"),
        F.when(F.col("id") == 0, F.lit(a + 1)).otherwise(F.lit(a + 7)).alias("times"),
    )
    got = collocations._lowest_cuts(kept, parts).first()
    assert got["score"] == 10**6 * a * a // ((a + 1) * (a + 7))


# 12

VECTORS = "vec_id long, embedding array<double>, rank string, score long, _row string, query long"


def vectors_table(spark, rows):
    return spark.createDataFrame([(*row, "r", 1, "x", 2) for row in rows], VECTORS).coalesce(1)


def vector_rows():
    pick = np.random.default_rng(3)
    rows = [(i, list(map(float, pick.normal(0, 0.3, 24)))) for i in range(300)]
    rows += [(i, [0.5] * 24) for i in range(300, 340)] + [(400, [0.5] * 24)] * 3
    rows += [(i, list(map(float, pick.normal(5, 0.01, 24)))) for i in range(450, 470)]
    rows += [(500, None), (550, [1.0, None] * 12), (600, [float("nan")] * 24), (650, [float("inf")] * 24)]
    rows += [(700, []), (701, []), (750, [1.0]), (800, [-3.5]), (None, [2.0]), (None, None)]
    return rows + [(-50, [1e12, 1.0]), (851, [1e12, 2.0]), (852, [-3e7, 4.0]), (900, [1e300, 1.0])]


def test_top_k(spark):
    rows = vector_rows()
    query = F.col("vec_id") % 50 == 0
    got = topk.top_k(vectors_table(spark, rows), query)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert found(got) == brute.top_k(rows)
    # Queries in many groups, blocks of few rows.
    small = topk.top_k(vectors_table(spark, rows), query, k=3, group_bytes=2000)
    assert found(small) == brute.top_k(rows, 3)
    assert topk.top_k(vectors_table(spark, []), query).count() == 0
    assert topk.top_k(vectors_table(spark, [(1, [1.0])]), query).count() == 0


def test_bounds_hold_and_prune():
    pick = np.random.default_rng(1)
    ids = np.arange(400)
    blocks = (np.arange(400)[:, None] // 100 - 1.5) * np.repeat(pick.normal(0, 60, 8), 8)
    values = np.floor(blocks + pick.normal(0, 20, (400, 64)))
    rows = topk._Vectors(ids, ids, ids < 0, values)
    exact = values @ values.T
    bounds = [s @ s.T + topk._SLACK * np.outer(rows.norms, rows.norms) for s in rows.statistics]
    assert all((bound >= exact).all() for bound in bounds) and len(bounds) == 3
    # Finer statistics are closer, and leave few pairs to score.
    assert (bounds[0].mean() > bounds[1].mean() > bounds[2].mean())
    best = topk._Best(rows, 5, np.full(400, topk._LEAST))
    best.compare(rows)
    assert (bounds[2] >= best.least[:, None]).mean() < 0.5
    far = topk._Best(rows, 5, np.full(400, topk._MOST))
    assert [len(x) for x in far._survivors(rows, rows, far.least)] == [0, 0, 0]


# 13

TURNS = "conv_id long, turn long, role string, text string, member string, place long, node string"


def turns_table(spark, rows):
    return spark.createDataFrame([(*row, "m", 3, "n") for row in rows], TURNS)


def trie(spark, rows, **limits):
    steps, members = prefixtrie.conversation_steps(turns_table(spark, rows), **limits)
    leader = F.col("member") - F.col("member") % 100
    heads = F.crc32(F.col("member").cast("string").cast("binary")) % 6
    rebuilt = prefixtrie.with_shared_heads(steps, members, leader, heads, most=5)
    return found(prefixtrie.prefix_trie(rebuilt, members))


def turn_rows():
    pick = random.Random(2)
    rows = []
    for conv in [*range(0, 30), *range(100, 140), *range(205, 230)]:
        for turn in range(pick.randint(1, 12)):
            rows.append((conv, turn, pick.choice(["user", "bot", None]), pick.choice(["a", "ü☃", "", None])))
    rows += [(300, turn, "user", f"t{turn % 7}") for turn in range(37)]
    rows += [(301, turn, "user", f"t{turn % 7}") for turn in range(37)]
    rows += [(7, 3, "user", "tie"), (7, 3, "user", "also"), (7, 3, "user", "also"), (8, None, "bot", "first")]
    rows += [(None, 1, "user", "nobody"), (None, None, None, None)]
    rows += [(1000 + i, 0, "system", "the same") for i in range(60)]
    return rows


def test_prefix_trie(spark):
    rows = turn_rows()
    want = brute.prefix_trie(rows)
    assert trie(spark, rows) == want
    assert trie(spark, rows, group_rows=15) == want
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "a", "b")]) == []


def test_turnless(spark):
    """A conversation whose own turns are all replaced by an absent leader's is a member of the root."""
    rows = [(key, 0, "user", "x") for key in range(1, 9)]
    want = brute.prefix_trie(rows)
    assert any(row[1] == 0 and row[6] == 0 for row in want)
    assert trie(spark, rows) == want


def test_hot_keys(spark, monkeypatch):
    """Keys that are used often are looked up by broadcast, with the same result."""
    monkeypatch.setattr(keyed, "LEAST_HOT_USES", 3)
    rows = spark.range(100).select("id", (F.col("id") % 20 * (F.col("id") % 2)).alias("key"))
    table = spark.range(0, 40, 3).select(F.col("id").alias("key"), F.lit("v").alias("value"))
    for how in ("inner", "left"):
        want = found(rows.join(table, "key", how), "id", "key", "value")
        assert found(keyed.lookup(rows, table, "key", how), "id", "key", "value") == want
    assert trie(spark, turn_rows()) == brute.prefix_trie(turn_rows())


@pytest.mark.parametrize(
    "name, table, columns, plain",
    [
        ("op11_collocations", "documents", ["lang", "text"], brute.collocations),
        ("op12_top_k", "embeddings", ["vec_id", "embedding"], brute.top_k),
        ("op13_prefix_trie", "conversations", ["conv_id", "turn", "role", "text"], brute.prefix_trie),
    ],
)
def test_queries(spark, small, name, table, columns, plain):
    rows = [tuple(row) for row in spark.read.parquet(f"{small}/{table}.parquet").select(*columns).collect()]
    assert found(QUERIES[name](spark, small)) == sorted(plain(rows), key=repr)
