"""Near-duplicates: families just below the threshold, repeated rows, null ids, very long texts."""

import numpy as np
import pytest

from tests.llm.test_operators import brute_components
from trailmark.llm import neardup
from trailmark.llm.words import hashes_of

SCHEMA = "doc_id long, text string, source string"


def family(n, changed=14, words=150, seed=7):
    """Texts of which any two share about seven tenths of their shingles."""
    rng = np.random.Generator(np.random.PCG64(seed))
    base = [f"v{i}" for i in range(words)]
    for i in range(n):
        text = list(base)
        at = int(rng.integers(0, words - changed))
        text[at : at + changed] = [f"n{i}x{j}" for j in range(changed)]
        yield i, " ".join(text), "a"


def test_rows_grow_with_the_members(spark, monkeypatch):
    """What leaves the signature pass grows with the family, not with its pairs."""
    sizes, whole = [], neardup._open_lists

    def counted(*args):
        found = whole(*args)
        sizes.append(found.count())
        return found

    monkeypatch.setattr(neardup, "_open_lists", counted)
    singles = []
    for n in (50, 100, 200):
        rows = list(family(n))
        found = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 4).collect()
        expected = brute_components([(key, text) for key, text, _ in rows], 4)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == expected
        singles.append(len({r["component_id"] for r in found}))
    assert singles[-1] > 20  # the family does not fall into one component
    assert all(size <= neardup.PREFIX * n for size, n in zip(sizes, (50, 100, 200)))
    assert sizes[2] < 2.5 * sizes[1] < 2.5 * 2.5 * sizes[0]


@pytest.mark.parametrize("block_bytes", [1_000, 100_000_000])
def test_links_whatever_the_blocks(spark, monkeypatch, block_bytes):
    """Links below the hubs of a list are found in blocks of one set and in one block."""
    monkeypatch.setattr(neardup, "BLOCK_BYTES", block_bytes)
    rows = list(family(60, changed=9)) + [(1000 + i, t, s) for i, t, s in family(60, 22, 160, 9)]
    found = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 4).collect()
    expected = brute_components([(key, text) for key, text, _ in rows], 4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == expected


def kept(spark, rows):
    found = neardup.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == ["doc_id", "text", "source"]
    return sorted(map(tuple, found.collect()), key=repr)


def test_keep_one_of_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"x{i}" for i in range(40))
    assert kept(spark, [(3, text, "a")] * 3) == [(3, text, "a")]
    assert kept(spark, [(None, text, "a"), (None, text, "b"), (7, text, "c")]) == [(7, text, "c")]
    assert len(kept(spark, [(None, text, "a"), (None, text, "b")])) == 1
    # One id with different texts, one of which is a copy of another id's.
    mixed = [(5, text, "a"), (5, other, "a"), (6, text, "b"), (None, other, "c")]
    assert kept(spark, mixed) == [(5, text, "a"), (5, other, "a")]
    empty = [(1, None, "a"), (1, None, "a"), (None, "", "a"), (2, " \n", None)]
    assert kept(spark, empty) == sorted(empty, key=repr)
    assert kept(spark, []) == []


def test_pieces_of_a_long_text(monkeypatch):
    text = "Ab  c\td\nE " * 50 + "f" * 90 + " g"
    whole = hashes_of(text, lower=True)
    monkeypatch.setattr("trailmark.llm.words.PIECE_BYTES", 7)
    assert (hashes_of(text, lower=True) == whole).all() and len(whole) == 202
    assert len(hashes_of(None)) == len(hashes_of("")) == 0


def test_very_long_texts(spark):
    """Copies of texts of several million characters meet within the budget of a block."""
    rng = np.random.Generator(np.random.PCG64(2))
    words = [f"w{x}" for x in rng.integers(0, 10**9, 300_000)]
    rows = [(i, " ".join([*words[: 299_000 + 100 * i], f"end{i}"]), "a") for i in range(6)]
    rows.append((9, " ".join(words[::-1]), "a"))
    assert [row[0] for row in kept(spark, rows)] == [0, 9]
