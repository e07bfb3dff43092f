"""What tasks of the language models and segmentations hold and look up, and that it leaves results alone."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from trailmark.llm import kneser_ney, sentencepieces
from trailmark.llm.queries import PIECE_MODEL
from trailmark.llm.words import words_of

TEXTS = ["the old house by the old mill " * 20, None, "", "  ", "a", "\x02x\x03 é😀  y" * 7, "the old house"]
LANGS = ["en", "en", "de", "en", "de", "de", "en"]
TRAINED = [True, True, False, True, True, True, False]
FOLDS = [0, 1, 0, 1, 1, 0, 1]


def _expected(order, running):
    """n-grams with their counts in trained rows, and in those of fold 0."""
    found = {}
    for lang, text, trained, fold in zip(LANGS, TEXTS, TRAINED, FOLDS):
        words = [w.decode().replace("\x02", "\x1a").replace("\x03", "\x1a") for w in words_of(text)]
        for sequence in [" ".join(words)] if running and words else words:
            whole = f"\x02{sequence}\x03"
            for end in range(2, len(whole) + 1):
                counts = found.setdefault((lang, whole[max(end - order, 0) : end]), [0, 0])
                counts[0] += trained
                counts[1] += trained and fold == 0
    return found


@pytest.mark.parametrize("chars", [1_000_000, 5])
@pytest.mark.parametrize("running", [False, True])
def test_counted_in_pieces(monkeypatch, running, chars):
    """A task gives each n-gram once, however the texts are cut, with the counts of the whole texts."""
    monkeypatch.setattr(kneser_ney, "CHUNK_CHARS", chars)
    columns = [pa.array(LANGS), pa.array(TEXTS), pa.array(TRAINED), pa.array(FOLDS, pa.int32())]
    rows = pa.RecordBatch.from_arrays(columns, names=["_lang", "_text", "_train", "_fold"])
    for order in (2, 4):
        batches = kneser_ney._count_grams(order, running)(iter([rows]))
        found = [row for batch in batches for row in batch.to_pylist()]
        assert max(Counter((r["lang"], r["gram"]) for r in found).values()) == 1
        assert {(r["lang"], r["gram"]): [r["n"], r["n_0"]] for r in found} == _expected(order, running)
        assert len({r["key"] for r in found}) == len(found)


@pytest.mark.parametrize("running", [False, True])
def test_scored_in_pieces(monkeypatch, running):
    """A long text has the score of its n-grams, and the same one in any company."""
    grams = _expected(4, running)

    def key_of(lang, gram):
        _, keys = kneser_ney._keys(gram, 4)
        return int(kneser_ney._salted(kneser_ney.mixed(keys[-1:]), lang)[0])

    logp = {key_of(*gram): -float(nth % 7 + 1) for nth, gram in enumerate(sorted(grams))}
    keys = np.array(sorted(logp), np.uint64)
    model = kneser_ney.Model.__new__(kneser_ney.Model)
    model.order, model.running = 4, running
    values = np.array([logp[k] for k in keys.tolist()], np.float32)
    model.arrays = type("Held", (), {"value": (keys, values)})()
    whole = model.scores()(LANGS, TEXTS)
    monkeypatch.setattr(kneser_ney, "CHUNK_CHARS", 5)
    assert model.scores()(LANGS, TEXTS) == whole
    assert [model.scores()([lang], [text])[0] for lang, text in zip(LANGS, TEXTS)] == whole
    # All values are whole numbers, so the sums are exact.
    once = Counter()
    for lang, text in zip(LANGS[:1], TEXTS[:1]):
        words = [w.decode() for w in words_of(text)]
        for sequence in [" ".join(words)] if running else words:
            marked = f"\x02{sequence}\x03"
            once.update((lang, marked[max(end - 4, 0) : end]) for end in range(2, len(marked) + 1))
    assert whole[0] == sum(n * logp[key_of(*gram)] for gram, n in once.items())


def test_places_of_keys():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 5000, np.uint64))
    keys[:40] = np.arange(40)
    wanted = np.concatenate([keys, keys + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)])
    found = kneser_ney._found(keys, kneser_ney._first_places(keys), wanted)
    assert (found == np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)).all()


def test_longer_pieces_only_where_one_begins(monkeypatch):
    """Places where no piece goes on are not looked up again for each longer size."""
    vocabulary = sentencepieces.Vocabulary(PIECE_MODEL)
    asked, find = [], sentencepieces.Vocabulary.find
    monkeypatch.setattr(
        sentencepieces.Vocabulary, "find", lambda self, keys: asked.append(len(keys)) or find(self, keys)
    )
    text = "qxzjkvwq" * 100
    sentencepieces._Lattice(vocabulary).nodes_of([text])
    assert sum(asked) < 4 * len(text)


def test_lattice_limit(monkeypatch):
    """Lattices that are dropped and built again give the samples of those kept."""
    vocabulary = sentencepieces.Vocabulary(PIECE_MODEL)
    texts = ["the old house", "  by   the mill ▁ é😀\n", "", "the old mill"]
    seeds = sentencepieces.mixed(np.arange(4, dtype=np.uint64))

    def samples(lattice):
        found = []
        for row, text in enumerate(texts):
            batch = sentencepieces._Batch([text], seeds[row : row + 1], lattice)
            found += sentencepieces._segmented(batch, [text], 2, vocabulary, False)[0]
        return [[(s["ids"].tolist(), s["logp"], s["perturbed"]) for s in row] for row in found]

    kept = samples(sentencepieces._Lattice(vocabulary))
    monkeypatch.setattr(sentencepieces, "LATTICE_NODES", 1)
    lattice = sentencepieces._Lattice(vocabulary)
    assert samples(lattice) == kept and [len(row) for row in kept] == [2, 2, 0, 2]
    assert lattice.nodes == sum(map(len, set(sentencepieces.split_words(texts[-1]))))
