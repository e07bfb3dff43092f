"""Words of texts and hashes of word windows, for use inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

# Text handled at once inside a task, in code points.
CHUNK_CHARS = 8_000_000

# Bytes of one text whose words are held as objects at once.
PIECE_BYTES = 4_000_000

_BLANK = re.compile(rb"\s")
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_ODD, -1, 1 << 64)


def words_of(text: str | None) -> list[bytes]:
    """The runs of characters outside \\x20 and \\x09-\\x0D, as UTF-8; none for null."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def chunks(
    batches: Iterator[pa.RecordBatch], text: str, chars: int = CHUNK_CHARS
) -> Iterator[pa.RecordBatch]:
    """Slices of `batches` with about `chars` code points of text each, or one longer text."""
    for batch in batches:
        sizes = np.asarray(
            pc.fill_null(pc.utf8_length(batch.column(text)), 0).cast(pa.int64())
        )
        starts = np.flatnonzero(np.diff(np.cumsum(sizes) // chars, prepend=-1))
        for start, end in zip(starts, [*starts[1:], len(sizes)]):
            yield batch.slice(start, end - start)


def hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def hashes_of(text: str | None, lower: bool = False) -> np.ndarray:
    """The hashes of a text's words, A-Z in lower case if asked; a long text is split piece by piece."""
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
    raw = raw.lower() if lower else raw
    found, at = [], 0
    while len(raw) - at > PIECE_BYTES and (cut := _BLANK.search(raw, at + PIECE_BYTES)):
        found.append(hashes(raw[at : cut.start()].split()))
        at = cut.start()
    found.append(hashes(raw[at:].split()))
    return np.concatenate(found)


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every bit of the input moves every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n-1 of an odd constant and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_ODD, _INVERSE)):
            factors = np.full(2 * n, base, np.uint64)
            factors[0] = 1
            _POWERS[i] = np.multiply.accumulate(factors)
    return _POWERS[0][:n], _POWERS[1][:n]


def window_hashes(of_words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each window of `size` words, given the words' hashes."""
    n = len(of_words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(of_words))
    total = np.zeros(len(of_words) + 1, np.uint64)
    np.cumsum(of_words * up, out=total[1:])
    return mixed((total[size:] - total[:-size]) * down[:n])


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Distinct hashes of the windows of `size` words; of fewer words all as one; of none nothing."""
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(hashes(words), min(size, len(words))))
