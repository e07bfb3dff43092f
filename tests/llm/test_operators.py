"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows, no rows and
columns named like its own, and against brute force on the driver's smallest documents."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from contract.compare import database, difference
from trailmark.llm import (
    classifier,
    fingerprints,
    kneser_ney,
    licenses,
    lines,
    mixing,
    neardup,
    quality,
    repeats,
    sentencepieces,
    warc,
)
from trailmark.llm.oracle import ORACLE
from trailmark.llm.queries import PIECE_MODEL, QUERIES, segmentation_digest

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
BASE = " ".join(f"word{i}" for i in range(120))
SCHEMA = """doc_id long, text string, lang string, source string, n_chars long, n long, id string,
    class long, key long, _id long, _text string, kept string, mix_slot string"""
ROWS = [
    (1, BASE + "\nRelease under the MIT License.", "en", "a", 1),
    (2, BASE, "en", "a", 1),
    (3, BASE.replace("word60 ", "other "), "en", "a", 1),
    (4, None, "en", None, None),
    (5, "", None, "", 0),
    (6, " \t\n \n", "de", "b", 6),
    (7, LONG, "en", "b", 1),
    (8, "one two", "fr", "b", 7),
    (8, "one two", "fr", "b", 7),
    (None, "Ünïcode ☃ words here\n☃\n☃", "fr", None, 5),
    (None, None, None, None, None),
    (9, "a b a b a b a b a b a b a b a b a b a b", "en", "c", 39),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*row, 0, "x", 1, 2, 3, "y", "z", "s") for row in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def by_id(df):
    found = defaultdict(list)
    for row in df.collect():
        found[row["doc_id"]].append(row)
    return found


def words(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def corpus(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def texts(corpus):
    return {row["doc_id"]: row["text"] for row in corpus.collect()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, small, name):
    assert difference(QUERIES[name](spark, small), database(small), ORACLE[name]) == ""


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= contract.queries().keys()


# 1


def test_licenses(docs, none):
    found = by_id(licenses.scan_licenses(docs))
    assert sum(map(len, found.values())) == len(ROWS)
    # 3 of 4 and 4 bigrams: 120 words, then "Release under the MIT License."
    assert found[1][0]["matches"] == [] and found[1][0]["n_windows"] == 1
    assert [found[i][0]["n_words"] for i in (4, 5, 6)] == [0, 0, 0]
    loose = by_id(licenses.scan_licenses(docs, min_dice=0.75))
    assert [tuple(m) for m in loose[1][0]["matches"]] == [("MIT", 0.75, 120)]
    assert licenses.scan_licenses(none).count() == 0


def prose(n, seed=0):
    rng = np.random.Generator(np.random.PCG64(seed))
    return " ".join(f"{'aeiou'[x % 5]}word{x}" for x in rng.integers(0, 500, n))


def test_license_bodies(spark):
    """Bodies, headers and wrapped notices, in prose, behind comment marks and with changed words."""
    body = " ".join(licenses.TEMPLATES["MIT body"].split())
    wrapped = "// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\n"
    header = "".join(f" * {line.strip()}\n" for line in licenses.TEMPLATES["GPL header"].strip().split("\n"))
    notice = f"{prose(30)} Licensed under the Apache License, Version 2.0. {prose(30, 1)}"
    changed = body.replace("persons to whom", "people to whom").replace("merge, publish", "publish")
    texts = {
        "mit": f"{prose(50)}\n{body}\n{prose(50, 2)}",
        "bsd": f"#!/bin/sh\n{wrapped}import os\n",
        "gpl": f"/*\n{header} */\nint main() {{}}",
        "apache": notice,
        "changed": changed,
        "upper": body.upper(),
        "half": " ".join(body.split()[:60]),
        "prose": prose(3000, 3) + " permission is granted to the reader of the software",
    }
    rows = [(i, text, "en", name, 1) for i, (name, text) in enumerate(texts.items())]
    found = by_id(licenses.scan_licenses(table(spark, rows)))
    names = {name: {m["license"] for m in found[i][0]["matches"]} for i, name in enumerate(texts)}
    assert names["mit"] == names["changed"] == names["upper"] == {"MIT body"}
    assert names["bsd"] == {"BSD-3-Clause"} and names["gpl"] == {"GPL header"}
    assert names["apache"] == {"Apache-2.0"} and names["half"] == names["prose"] == set()
    exact = {name: max((m["dice"], m["word"]) for m in found[i][0]["matches"]) for i, name in enumerate(texts) if names[name]}
    assert exact["mit"] == (1.0, 50) and exact["bsd"] == (1.0, 2) and exact["apache"] == (1.0, 30)
    assert 0.8 <= exact["changed"][0] < 1
    every = [(i, text, "en", "a", 1) for i, text in enumerate(licenses.TEMPLATES.values())]
    found = by_id(licenses.scan_licenses(table(spark, every)))
    for i, name in enumerate(licenses.TEMPLATES):
        assert (name, 1.0, 0) in [tuple(m) for m in found[i][0]["matches"]]


def test_license_anchors():
    """A window that reaches the coefficient holds an anchor: bigrams kept at random."""
    rng = np.random.Generator(np.random.PCG64(4))
    for text in licenses.TEMPLATES.values():
        words = licenses.template_words(text)
        pairs = list(zip(words, words[1:]))
        known = [offset for _, offset in licenses.anchors(words)]
        least = math.ceil(len(pairs) * 0.8 / 1.2)
        assert len(known) == len(pairs) - least + 1
        for _ in range(50):
            assert set(rng.permutation(len(pairs))[:least].tolist()) & set(known)


# 2


def brute_repeats(pairs, size):
    seen = Counter()
    for _, text in pairs:
        w = words(text)
        seen.update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    for key, text in pairs:
        w = words(text)
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        yield key, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()


@pytest.mark.parametrize("hot", [1000, 2])
@pytest.mark.parametrize("sizes", [(35, 16), (5, 3)])
def test_repeats(docs, none, corpus, monkeypatch, hot, sizes):
    monkeypatch.setattr(repeats, "HOT_ROWS", hot)
    for frame in (docs, corpus):
        pairs = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
        found = [
            (r["doc_id"], r["n_words"], r["n_removed"], r["text"])
            for r in repeats.remove_repeats(frame, *sizes).collect()
        ]
        assert sorted(found, key=repr) == sorted(brute_repeats(pairs, sizes[0]), key=repr)
    assert repeats.remove_repeats(none).count() == 0


# 3, 8


def brute_model(pairs, order):
    """Log probability of a word under interpolated modified Kneser-Ney, by its definition."""
    counts = [Counter() for _ in range(order + 1)]
    scored = set()
    for text, train in pairs:
        for w in words(text):
            s = "\x02" + w.decode() + "\x03"
            for i in range(1, len(s)):
                g = s[max(0, i - order + 1) : i + 1]
                scored.add(g)
                if train:
                    counts[len(g)][g] += 1
    for n in range(order - 1, 0, -1):
        counts[n].update(Counter(g[1:] for g in counts[n + 1]))
    offs, context = {}, {}
    for n in range(1, order + 1):
        c = [sum(v == i for v in counts[n].values()) for i in range(5)]
        d = [0, 0.5, 1.0, 1.5]
        if min(c[1:]):
            y = c[1] / (c[1] + 2 * c[2])
            d = [0, *(max(0.05, i - (i + 1) * y * c[i + 1] / c[i]) for i in (1, 2, 3))]
        offs[n] = d
        for g, v in counts[n].items():
            total, free = context.get((n, g[:-1]), (0, 0.0))
            context[n, g[:-1]] = total + v, free + min(d[min(v, 3)], v)
    kinds = len(counts[1])

    def p(g):
        n = len(g)
        lower = p(g[1:]) if n > 1 else 1 / (kinds + 1)
        if (n, g[:-1]) not in context:
            return lower
        total, free = context[n, g[:-1]]
        v = counts[n][g]
        return (max(v - min(offs[n][min(v, 3)], v), 0) + free * lower) / total

    return {g: math.log(p(g)) for g in scored}


def brute_log_ppl(text, logp, order):
    total = symbols = 0
    for w in words(text):
        s = "\x02" + w.decode() + "\x03"
        total += sum(logp[s[max(0, i - order + 1) : i + 1]] for i in range(1, len(s)))
        symbols += len(s) - 1
    return -total / symbols if symbols else None


@pytest.mark.parametrize("entries", [kneser_ney.ARRAY_ENTRIES, 10])
def test_quality_perplexity(corpus, entries):
    """Held in tasks, and joined by shuffle where it is too large."""
    found = {r["doc_id"]: r for r in quality.quality_report(corpus, array_entries=entries).collect()}
    rows = corpus.collect()
    for lang in ("en", "fr"):
        own = [r for r in rows if r["lang"] == lang]
        logp = brute_model([(r["text"], True) for r in own], 4)
        for r in own[:40]:
            assert found[r["doc_id"]]["log_ppl"] == pytest.approx(brute_log_ppl(r["text"], logp, 4), rel=1e-5)


def brute_band(values, ranges=(6.0, 12.0)):
    """The shortest stretch between percentiles i and i + 50, and its width at least 0.01."""
    values = sorted(values)
    at = [values[max(0, math.ceil(i * len(values) / 100) - 1)] for i in range(101)]
    low, high = min(((at[i + 50] - at[i], at[i], at[i + 50]) for i in range(51)))[1:]
    width = max(high - low, 0.01)
    return (low, high), (low - ranges[0] * width, high + ranges[1] * width)


def test_quality_kept(spark, corpus):
    """The verdict, from the log perplexities and the bands of distinct texts."""
    rows = [(r["doc_id"], r["text"], r["lang"], "a", 1) for r in corpus.collect()]
    rng = np.random.Generator(np.random.PCG64(8))
    for i in range(6):  # of which some lie outside
        rows.append((10_000 + i, " ".join("".join(map(chr, rng.integers(0x4E00, 0x9000, 7))) for _ in range(40)), "en", "a", 1))
    found = quality.quality_report(table(spark, rows)).collect()
    texts = {row[0]: row[1] for row in rows}
    verdicts = Counter()
    for lang in {row[2] for row in rows}:
        ids = {row[0] for row in rows if row[2] == lang}
        own = [r for r in found if r["doc_id"] in ids and not r["base_failed"]]
        _, band = brute_band({texts[r["doc_id"]]: r["log_ppl"] for r in own}.values())
        half, _ = brute_band([r["log_ppl"] for r in own])
        low, high = min(band[0], half[0]), max(band[1], half[1])
        for r in own:
            if min(abs(r["log_ppl"] - low), abs(r["log_ppl"] - high)) > 1e-9:
                assert r["kept"] == (low <= r["log_ppl"] <= high), (lang, r)
                verdicts[r["kept"]] += 1
    assert verdicts[False] and verdicts[True] > 100


@pytest.mark.parametrize("share", [0.05, 0.2, 0.33])
def test_quality_junk(spark, share):
    """Random letters, up to a third of a language, are rejected and its clean texts stay."""
    larger = "/root/testdata/sf0.01"
    clean = spark.read.parquet(f"{larger}/documents.parquet").filter("lang = 'en'").collect()
    rng = np.random.Generator(np.random.PCG64(6))
    rows = [(r["doc_id"], r["text"], "en", "a", 1) for r in clean]
    n = int(len(rows) * share / (1 - share))
    for i in range(n):
        sizes = rng.integers(2, 10, rng.integers(60, 300))
        text = " ".join("".join(map(chr, rng.integers(97, 123, size))) for size in sizes)
        rows.append((100_000 + i, text, "en", "a", 1))
    found = quality.quality_report(table(spark, rows)).filter("not base_failed").collect()
    junk = [r["kept"] for r in found if r["doc_id"] >= 100_000]
    good = {r["doc_id"] for r in spark.read.parquet(f"{larger}/labels.parquet").filter("quality = 1 and toxic = 0").collect()}
    labelled = [r["kept"] for r in found if r["doc_id"] in good]
    assert len(junk) == n and np.mean(junk) < 0.1 and np.mean(labelled) > 0.98


def test_quality_facts(texts, corpus):
    for row in quality.quality_report(corpus).collect():
        text = texts[row["doc_id"]]
        w = words(text)
        lines_ = [x for x in text.split("\n") if x.encode().split()]
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        seen = Counter(grams)
        hit = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 5)}
        assert (row["n_words"], row["word_chars"]) == (len(w), sum(len(x.decode()) for x in w))
        assert row["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert row["n_dup_lines"] == len(lines_) - len(set(lines_))
        assert row["n_repeat_words"] == len(hit)
        assert row["base_failed"] == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
        assert row["kept"] <= (not row["base_failed"])


def test_quality_edges(docs, none):
    found = by_id(quality.quality_report(docs))
    assert sum(map(len, found.values())) == len(ROWS)
    assert all(found[i][0]["base_failed"] and found[i][0]["log_ppl"] is None for i in (4, 5, 6))
    assert found[9][0]["base_failed"] and not found[7][0]["base_failed"]
    kept = quality.keep_quality(docs)
    assert kept.columns == docs.columns
    expected = sorted(i for i, group in found.items() for r in group if r["kept"])
    assert sorted(r["doc_id"] for r in kept.collect()) == expected and {1, 2, 3} <= set(expected)
    assert quality.quality_report(none).count() == 0 and quality.keep_quality(none).count() == 0


@pytest.mark.parametrize("copies", [0, 60, 240])
def test_quality_copies(spark, corpus, copies):
    """Copies of one text, up to 80 % of a language, reject neither the other documents nor itself."""
    clean = [r["text"] for r in corpus.filter("lang = 'en'").collect() if len(words(r["text"])) > 60]
    hot = clean[0]
    others = list(dict.fromkeys(clean[1:]))[:60]
    rows = [(i, x, "xx", "a", 1) for i, x in enumerate(others + [hot] * copies)]
    found = quality.quality_report(table(spark, rows)).filter("not base_failed").collect()
    gone = {r["doc_id"] for r in found if not r["kept"]}
    assert len(found) > copies + 30 and not any(i >= len(others) for i in gone) and len(gone) <= 3, gone


def test_quality_equal_quartiles(spark):
    """Where most texts have one perplexity, a text next to them is not rejected."""
    base = [f"word{i}" for i in range(200)]
    texts = [" ".join(base[i:] + base[:i]) for i in range(20)]
    texts += [" ".join([*base, f"word{i}"]) for i in range(4)]
    report = quality.quality_report(table(spark, [(i, x, "xx", "a", 1) for i, x in enumerate(texts)]))
    assert all(r["kept"] for r in report.collect())


def test_classifier(spark, docs, none):
    larger = "/root/testdata/sf0.01"
    corpus = spark.read.parquet(f"{larger}/documents.parquet")
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    good = [r["doc_id"] for r in labels.filter("quality = 1").collect()]
    bad = [r["doc_id"] for r in labels.filter("quality = 0").collect()]
    trusted = labels.filter("quality = 1 and doc_id % 2 = 0")
    found = {r["doc_id"]: r for r in classifier.classify(corpus, trusted).collect()}
    held_out = [i for i in good if i % 2]
    assert np.mean([found[i]["kept"] for i in held_out]) > 0.85
    assert np.mean([found[i]["perplexity"] or 0 for i in held_out]) < np.mean([found[i]["perplexity"] for i in bad])
    edges = by_id(classifier.classify(docs, trusted.select(F.lit(2).cast("long").alias("doc_id"))))
    assert sum(map(len, edges.values())) == len(ROWS)
    assert edges[2][0]["kept"] and edges[2][0]["trusted"] and not edges[4][0]["kept"]
    assert edges[8][0]["kept"] and edges[8][0]["threshold"] is None
    assert classifier.classify(none, trusted).count() == 0
    assert classifier.classify(docs, trusted.limit(0)).filter("threshold is not null").count() == 0


@pytest.mark.parametrize("order", [classifier.ORDER, 4])
@pytest.mark.parametrize("entries", [kneser_ney.ARRAY_ENTRIES, 10])
def test_classifier_across_words(spark, corpus, entries, order):
    """Perplexity of the text as one sequence, threshold and verdict by their definition."""
    odd = ["a", "a b c d e f", "abcdefgh", "Ünï ☃\t\n the  end", "x\x02y \x03z of", " ", None]
    rows = [(r["doc_id"], r["text"], r["lang"], "a", 1) for r in corpus.collect()]
    rows += [(10_000 + i, text, "en", "a", 1) for i, text in enumerate(odd)]
    trusted = corpus.filter("doc_id % 3 = 0").select("doc_id")
    ids = {r["doc_id"] for r in trusted.collect()}
    found = classifier.classify(table(spark, rows), trusted, order=order, array_entries=entries, quantile=0.9)
    found = {r["doc_id"]: r for r in found.collect()}
    assert len(found) == len(rows)
    half = {r[0]: r[1] for r in table(spark, rows).selectExpr("doc_id", "pmod(xxhash64(doc_id), 2)").collect()}

    def joined(text):  # to `brute_model` one word
        plain = (text or "").replace("\x02", "\x1a").replace("\x03", "\x1a")
        return "\x1f".join(w.decode() for w in words(plain))

    for lang in ("en", "fr"):
        own = {r[0]: joined(r[1]) for r in rows if r[2] == lang}
        logp = brute_model([(text, i in ids) for i, text in own.items()], order)
        ppl = {i: brute_log_ppl(text, logp, order) for i, text in own.items()}
        for i, value in ppl.items():
            if value is None:
                assert found[i]["perplexity"] is None and not found[i]["kept"]
            else:
                assert math.log(found[i]["perplexity"]) == pytest.approx(value, rel=1e-5)
        known = [i for i in ids & own.keys() if ppl[i] is not None]
        values = [[found[i]["perplexity"] for i in known], []]
        for k in (0, 1):  # each half by the model of the other
            logp = brute_model([(own[i], half[i] != k) for i in known], order)
            values[1] += [math.exp(brute_log_ppl(own[i], logp, order)) for i in known if half[i] == k]
        threshold = max(sorted(x)[math.ceil(0.9 * len(known)) - 1] for x in values)
        for i in own:
            assert found[i]["threshold"] == pytest.approx(threshold, rel=1e-5)
            if ppl[i] is not None and abs(found[i]["perplexity"] - threshold) > 1e-4:
                assert found[i]["kept"] == (found[i]["perplexity"] < threshold)
    assert {r["kept"] for r in found.values()} == {True, False}


def test_classifier_sees_word_order(spark):
    """Shuffled words are less likely than the text they come from."""
    rng = np.random.Generator(np.random.PCG64(4))
    who, does, what = ["the dog", "the cat", "a bird"], ["sees", "has seen", "looks at"], ["the big tree", "a small house", "the old man"]
    texts = [" ".join(f"{rng.choice(who)} {rng.choice(does)} {rng.choice(what)}" for _ in range(20)) for _ in range(60)]
    rows = [(i, text, "en", "a", 1) for i, text in enumerate(texts)]
    rows += [(100 + i, " ".join(rng.permutation(text.split())), "en", "a", 1) for i, text in enumerate(texts)]
    docs = table(spark, rows)
    found = {r["doc_id"]: r for r in classifier.classify(docs, docs.filter("doc_id < 40").select("doc_id")).collect()}
    assert all(found[100 + i]["perplexity"] > 1.2 * found[i]["perplexity"] for i in range(60))
    assert all(found[i]["kept"] and not found[100 + i]["kept"] for i in range(40))


# 4


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepieces.Vocabulary(PIECE_MODEL)


def test_segmentations(docs, none, vocabulary):
    found = sentencepieces.sample_segmentations(docs, vocabulary, k=3)
    again = by_id(sentencepieces.sample_segmentations(docs.repartition(5), vocabulary, k=3))
    rows = by_id(found)

    def ids_of(group):
        return sorted(str([s["ids"] for s in r["samples"]]) for r in group)

    assert {k: ids_of(v) for k, v in rows.items()} == {k: ids_of(v) for k, v in again.items()}
    assert all(r["round_trip"] for group in rows.values() for r in group)
    for group in rows.values():
        for r in group:
            ids = [tuple(s["ids"]) for s in r["samples"]]
            assert len(set(ids)) == len(ids)
            values = [s["perturbed"] for s in r["samples"]]
            assert values == sorted(values, reverse=True)
    assert [len(rows[i][0]["samples"]) for i in (4, 5)] == [0, 0]
    first = found.withColumn("ids", F.get("samples", F.lit(0))["ids"]).select("doc_id", "ids")
    decoded = by_id(sentencepieces.decode(first, vocabulary, "ids"))
    for row in docs.select("doc_id", "text").collect():
        if row["doc_id"] not in (None, 8):
            assert decoded[row["doc_id"]][0]["decoded"] == (row["text"] or None)
    assert sentencepieces.sample_segmentations(none, vocabulary).count() == 0


def test_segmentation_digest(docs, vocabulary):
    """The query's sizes, hashes and round trip are those of the ids that the operator returns."""
    found = sentencepieces.sample_segmentations(docs, vocabulary).select(
        "doc_id", "round_trip", F.transform("samples", lambda s: s["ids"]).alias("ids")
    )
    hashed = F.transform("ids", lambda x: F.struct(F.size(x).cast("long"), F.xxhash64(x)))
    expected = found.select("doc_id", "round_trip", hashed.alias("x")).collect()
    digest = segmentation_digest(docs, PIECE_MODEL)
    brief = F.transform("samples", lambda s: F.struct(s["n_pieces"], s["ids_hash"]))
    got = digest.select("doc_id", "round_trip", brief.alias("x")).collect()
    plain = lambda rows: sorted(str((r[0], r[1], [tuple(x) for x in r[2]])) for r in rows)
    assert plain(got) == plain(expected) and any(len(r["x"]) == 2 for r in got)
    each = found.select("doc_id", F.posexplode("ids").alias("nth", "ids"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    decoded = sentencepieces.decode(each, vocabulary, "ids").collect()
    assert all(r["decoded"] == texts[r["doc_id"]] for r in decoded if r["doc_id"] is not None) and {r["nth"] for r in decoded} == {0, 1}


def test_round_trip_of_all_samples(vocabulary, monkeypatch):
    """A later sample that does not decode to its text is noticed too."""
    lattice = sentencepieces._Lattice(vocabulary)
    text = "the old house"
    batch = sentencepieces._Batch([text], sentencepieces.mixed(np.arange(1, dtype=np.uint64)), lattice)
    plain, seen = sentencepieces._ids, []

    def damaged(*args):
        ids, many = plain(*args)
        seen.append(ids.copy())
        return (ids if len(seen) == 1 else ids[::-1]), many

    monkeypatch.setattr(sentencepieces, "_ids", damaged)
    _, same = sentencepieces._segmented(batch, [text], 2, vocabulary, False)
    assert len(seen) == 2 and not same[0]


def test_sampling_distribution(vocabulary):
    """Ordered samples of a small text occur as often as drawing without replacement makes them."""
    weight = {
        vocabulary.surface[i].decode().replace(" ", "▁"): (i, w)
        for i, w in zip(vocabulary.ids.tolist(), vocabulary.weights.tolist())
    }

    def splits(word):
        if not word:
            return [((), 0.0)]
        out = []
        for n in range(1, len(word) + 1):
            if word[:n] in weight:
                i, w = weight[word[:n]]
                out += [((i, *rest), w + more) for rest, more in splits(word[n:])]
        return out

    text, every = "the in", [((), 0.0)]
    for word in sentencepieces.split_words(text):
        every = [(a + b, x + y) for a, x in every for b, y in splits(word)]
    total = sum(math.exp(w) for _, w in every)
    p = {ids: math.exp(w) / total for ids, w in every}
    n = 20_000
    lattice = sentencepieces._Lattice(vocabulary)
    batch = sentencepieces._Batch([text] * n, sentencepieces.mixed(np.arange(n, dtype=np.uint64)), lattice)
    found, _ = sentencepieces._segmented(batch, [text] * n, 2, vocabulary, False)
    pairs = Counter(tuple(tuple(s["ids"].tolist()) for s in row) for row in found)
    for (a, b), seen in pairs.items():
        expected = n * p[a] * p[b] / (1 - p[a])
        assert a != b and abs(seen - expected) < 5 * math.sqrt(expected) + 5
    assert found[0][0]["logp"] == pytest.approx(math.log(p[tuple(found[0][0]["ids"].tolist())]))
    mass = np.mean([sum(math.exp(s["logp"] - s["log_inclusion"]) for s in row) for row in found])
    assert mass == pytest.approx(1, abs=0.05)


# 5


def test_warc_edges(spark):
    schema = "file long, offset long, digest string, hash string, at long"
    one = [(f, o * 700, f"d{f}{o}", "h", 1) for f in range(3) for o in range(400)]
    two = [r for r in one if r[:2] != (1, 7000)]
    two = [(*r[:2], "bad", *r[3:]) if r[:2] == (2, 210_000) else r for r in two]
    extra = [(None, 1, "x", "h", 1), (0, 0, one[0][2], "h", 1)]
    a, b = (spark.createDataFrame(rows + extra, schema) for rows in (one, two))
    roots, damaged = warc.audit(a, b, leaf_bytes=4096, fanout=4)
    assert {r["file"]: r["intact"] for r in roots.collect()} == {0: True, 1: False, 2: False}
    found = {(r["file"], r["offset"]): (r["digest"], r["replica_digest"]) for r in damaged.collect()}
    assert found == {(1, 7000): ("d110", None), (2, 210_000): ("d2300", "bad")}
    empty = spark.createDataFrame([], schema)
    roots, damaged = warc.audit(empty, empty)
    assert roots.count() == 0 and damaged.count() == 0


# 6


def test_lines(docs, none, spark):
    page = [(i, f"menu\nmenu\ntext {i}\n\nmenu ", "en", "s" if i % 2 else None, 3) for i in range(8)]
    found = lines.drop_boilerplate(table(spark, page), max_ratio=0.5)
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in found.collect()} == {
        (i, f"text {i}\n", 7) for i in range(8)
    }
    report = by_id(lines.line_report(docs))
    assert sum(map(len, report.values())) == len(ROWS)
    assert report[4][0]["text"] is None and report[4][0]["n_lines"] == 0 and report[5][0]["text"] == ""
    assert lines.drop_boilerplate(docs).columns == docs.columns
    assert lines.line_report(none).count() == 0


# 7


def test_fingerprints(docs, none, corpus, texts):
    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    ids = sorted(texts)
    found = {r["doc_id"]: r for r in fingerprints.edit_probe(corpus, digest).collect()}
    alone = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(corpus).collect()}
    assert sorted(found) == ids
    errors = []
    for here, after in zip(ids, [*ids[1:], ids[0]]):
        text, other = texts[here], texts[after]
        half = len(text) // 2
        changed = text[: len(text) - half] + other[:half]
        row = found[here]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), digest(changed))
        assert row["fingerprint"] == alone[here]
        sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(words, (text, changed, other))]
        for near, x in ((row["near_edited"], sets[1]), (row["near_next"], sets[2])):
            errors.append(near - len(sets[0] & x) / len(sets[0] | x))
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.2
    edges = by_id(fingerprints.edit_probe(docs, digest))
    assert sum(map(len, edges.values())) == len(ROWS)
    assert edges[4][0]["fingerprint"] == "" and edges[5][0]["near_next"] == 1.0
    assert fingerprints.edit_probe(none, digest).count() == 0


# 9


def test_mix(docs, none, spark):
    rows = [(i, "t", "en", "abc"[min(i % 6, 2)], 1) for i in range(3000)]
    mixed = mixing.mix(table(spark, rows), {"a": 1, "b": 2, "c": 4}, block_rows=10, period=70)
    blocks = sorted({(r["mix_slot"], r["source"]) for r in mixed.filter("mix_kept").collect()})
    assert [slot for slot, _ in blocks] == list(range(len(blocks)))
    given = Counter()
    for slot, source in blocks:
        given[source] += 1
        for name, share in {"a": 10, "b": 20, "c": 40}.items():
            assert abs(given[name] - (slot + 1) * share / 70) < 1
    assert mixed.count() == 3000 and len(blocks) > 150
    found = mixing.mix(docs, block_rows=1)
    assert found.count() == len(ROWS)
    assert found.columns == [c for c in docs.columns if c != "mix_slot"] + ["mix_block", "mix_slot", "mix_kept"]
    assert mixing.mix(none).count() == 0
    assert mixing.mix(docs, {"a": 1, "absent": 1}).filter("mix_kept").count() == 0


def test_mix_keeps_all(spark):
    """A tiny source neither cuts the others nor is cut, and leaves its slots when it has run out."""
    sizes = {"hot": 3300, "mid": 350, "tiny": 10, None: 1}
    rows = [(i, "t", "en", s, 1) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = table(spark, rows)
    mixed = mixing.mix(docs).collect()
    assert sorted(r["doc_id"] for r in mixed if r["mix_kept"]) == list(range(len(rows)))
    source = {r["mix_slot"]: r["source"] for r in mixed}
    assert sorted(source) == list(range(207 + 22 + 1 + 1))
    weight = {name: math.sqrt(n) for name, n in sizes.items()}
    given = Counter()
    for slot in range(229):
        given[source[slot]] += 1
        if given["mid"] < 22 and given["hot"] < 207:
            # Both are within a block of one number of slots at their weights, to 1 / 1000.
            low, high = (
                max((given[s] - 1) / weight[s] for s in ("hot", "mid")),
                min((given[s] + 1) / weight[s] for s in ("hot", "mid")),
            )
            assert low <= high * 1.01
    slots = {r["doc_id"]: r["mix_slot"] for r in mixed}
    ordered = [slots[r["doc_id"]] for r in mixing.interleave(docs).collect()]
    assert ordered == sorted(slots.values())


def mixed_blocks(spark, sizes, weights, **options):
    """{slot: source} of the kept blocks, and {(source, block): slot} of all."""
    names = [source for source, n in sizes.items() for _ in range(n)]
    rows = [(i, "t", "en", source, 1) for i, source in enumerate(names)]
    found = mixing.mix(table(spark, rows), weights, block_rows=1, **options).collect()
    assert len(found) == len(rows)
    kept = {r["mix_slot"]: r["source"] for r in found if r["mix_kept"]}
    return kept, {(r["source"], r["mix_block"]): r["mix_slot"] for r in found}


@pytest.mark.parametrize("n, hot, rows", [(20, 20, 30), (100, 99, 12), (1500, 40, 2)])
def test_mix_prefixes(spark, n, hot, rows):
    """After any number of slots each source is within a block of its share, for any number of them."""
    weights = {f"s{i}": 1.0 + i % 3 for i in range(n - 1)} | {"hot": float(hot)}
    sizes = {source: math.ceil(rows * weight) for source, weight in weights.items()}
    kept, slots = mixed_blocks(spark, sizes, weights)
    assert sorted(kept) == list(range(len(kept))) and len(kept) > sum(weights.values())
    assert len(set(slots.values())) == len(slots)
    known = spark.createDataFrame(list(weights.items()), "source string, weight double")
    schedule = mixing._schedule(known, 1000)
    plan = schedule.plan.select("_source", "share").distinct().collect()
    shares = {r["_source"][1:]: r["share"] / schedule.period for r in plan}
    assert len(shares) == n and abs(sum(shares.values()) - 1) < 1e-9
    given = Counter()
    for slot in range(len(kept)):
        given[kept[slot]] += 1
        if slot % (1 + n // 100) == 0:
            assert all(abs(given[s] - (slot + 1) * share) < 1 for s, share in shares.items())


def test_mix_light_sources(spark):
    """Sources below a slot of the period have all rows placed and hardly move the others."""
    sizes, weights = {"a": 100, "b": 200, "c": 400}, {"a": 1, "b": 2, "c": 4}
    kept, alone = mixed_blocks(spark, sizes, weights)
    _, beside = mixed_blocks(spark, sizes, weights | {"absent": 1e-6})
    assert max(abs(beside[block] - slot) for block, slot in alone.items()) <= 2
    sizes |= {"d": 3, "e": 2}
    kept, slots = mixed_blocks(spark, sizes, weights | {"d": 0.003, "e": 0.002}, period=100)
    assert len(set(slots.values())) == len(slots) == 705
    # One slot in 1,401 is theirs, in the middle of each stretch; the first is d's.
    light = sorted(slots["d", i] for i in range(3)) + sorted(slots["e", i] for i in range(2))
    assert sorted(light) == [700 + 1401 * i for i in range(5)] and slots["d", 0] == 700
    # b has 29 of 100 scheduled slots, and 200 blocks.
    assert sorted(kept) == list(range(len(kept))) and 685 < len(kept) < 700
    partly = mixed_blocks(spark, {"hot": 5, "rare": 2}, {"rare": 1, "gone": 1e-4})[1]
    assert all((slot is None) == (block[0] == "hot") for block, slot in partly.items() if block[1] is None)


def test_mix_beyond_the_scheduled(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SCHEDULED", 3)
    sizes = {f"s{i}": 4 + i for i in range(9)}
    weights = {source: float(n) for source, n in sizes.items()}
    kept, slots = mixed_blocks(spark, sizes, weights)
    assert len(set(slots.values())) == len(slots) == sum(sizes.values())
    assert sorted(kept) == list(range(len(kept))) and len(kept) > 30
    given = Counter()
    for slot in range(len(kept)):
        given[kept[slot]] += 1
        total = sum(weights.values())
        assert all(abs(given[s] - (slot + 1) * w / total) < 2 for s, w in weights.items())
    mixed = mixing.mix(table(spark, [(i, "t", "en", f"s{i % 9}", 1) for i in range(90)]), block_rows=1)
    assert sorted(r["mix_slot"] for r in mixed.collect()) == list(range(90))


# 10


def brute_components(pairs, size, percent=80):
    sets = {}
    for key, text in pairs:
        w = [x.lower() for x in words(text)]
        sets[key] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    names = sorted(sets)
    parent = {n: n for n in names}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {n: (len(sets[n]), root(n)) for n in names}


@pytest.mark.parametrize("block", [1000, 2])
def test_near_duplicates(spark, docs, none, corpus, texts, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 4000 * block)
    rng = np.random.Generator(np.random.PCG64(3))
    base = [f"v{i}" for i in range(150)]
    family = []
    for i in range(60):  # a family of copies whose similarities lie around the threshold
        w = list(base)
        for at in rng.integers(0, 150, rng.integers(0, 6)):
            w[at] = f"new{i}"
        family.append((10_000 + i, " ".join(w), "en", "a", 1))
    rows = [(k, v, "en", "a", 1) for k, v in texts.items()] + family
    expected = brute_components([(r[0], r[1]) for r in rows], 4)
    found = neardup.near_duplicates(table(spark, rows), 4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_near_duplicate_edges(docs, none):
    found = by_id(neardup.near_duplicates(docs))
    assert sum(map(len, found.values())) == len(ROWS)
    assert [found[i][0]["component_id"] for i in (1, 2, 3)] == [1, 1, 1]
    assert found[4][0]["component_id"] == 4 and found[4][0]["n_shingles"] == 0 and found[4][0]["kept"]
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 4, 5, 6, 7, 8, None, None, 9])
    assert neardup.near_duplicates(none).count() == 0
