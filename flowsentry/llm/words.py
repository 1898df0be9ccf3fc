"""Words of a text as bytes, and 64-bit hashes of word runs, for whole batches at a time."""

from __future__ import annotations

import numpy as np

_LETTERS = bytes(range(97, 123))
# A-Z fold to a-z; digits, letters and everything beyond ASCII belong to words, all else separates them.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or c in _LETTERS or c >= 128 else 32 for c in range(256))
IS_WORD = np.array([FOLD[c] != 32 for c in range(256)])

_ODD = np.uint64(0x9E3779B97F4A7C15)


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_places(folded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in folded bytes."""
    inside = np.concatenate([[False], folded != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(folded: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: mixed bytes weighted by an odd power of their distance from the end."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    length = end - begin
    powers = np.empty(int(length.max()) + 1, np.uint64)
    powers[0] = 1
    with np.errstate(over="ignore"):
        powers[1:] = _ODD
        powers = np.multiply.accumulate(powers)
        spread = mixed(np.arange(256, dtype=np.uint64) + _ODD)
        # distance of every word byte from its word's end; separators count nothing
        last = np.repeat(end, length)
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum()))
        parts = spread[folded[at]] * powers[last - at]
        sums = np.add.reduceat(parts, np.concatenate([[0], np.cumsum(length)[:-1]]))
        return mixed(sums + length.astype(np.uint64) * _ODD)


def shingles(raw: bytes, size: int) -> np.ndarray:
    """Hashes of every run of `size` words, in order; one of all words for a shorter text, none without words."""
    folded = np.frombuffer(raw.translate(FOLD), np.uint8)
    begin, end = word_places(folded)
    words = word_hashes(folded, begin, end)
    if not len(words):
        return words
    run = min(size, len(words))
    out = np.full(len(words) - run + 1, np.uint64(run), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(run):
            out = mixed(out * _ODD + words[k:len(words) - run + 1 + k])
    return out
