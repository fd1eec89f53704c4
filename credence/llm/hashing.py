"""Word and n-gram hashes of whole batches of texts, by numpy."""

from __future__ import annotations

import numpy as np

ODD = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1

#: Word bytes (ASCII letters and digits, and all bytes above 127), lower-cased; 0 for all others.
FOLD = np.zeros(256, np.uint64)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    FOLD[_low : _high + 1] = np.arange(_low, _high + 1)
FOLD[0x41:0x5B] += np.uint64(32)


def powers(n: int) -> np.ndarray:
    """1, ODD, ODD**2, ... modulo 2**64."""
    out = np.ones(1, np.uint64)
    step = ODD
    while len(out) < n:
        out = np.concatenate((out, out * np.uint64(step)))
        step = step * step & MASK
    return out[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = FOLD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of consecutive texts, and where each text's words begin among them.

    A word's hash is a polynomial in its bytes as ``fold`` maps them. Words end with their text.
    """
    folded = fold[data]
    inside = folded != 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    start[heads] = inside[heads]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    letters = folded[inside]
    first = np.flatnonzero(start[inside])
    size = np.diff(first, append=len(letters))
    place = np.arange(len(letters)) - np.repeat(first, size)
    h = np.add.reduceat(letters * powers(int(size.max()))[place], first)
    return mixed(h), np.searchsorted(starts, offsets)


def stem_hashes(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and after each text's words those of their first ``n`` bytes as words."""
    cut = data.copy()
    inside = FOLD[data] != 0
    # a byte that follows n bytes of its word is beyond the stem
    beyond = inside.copy()
    for k in range(1, n + 1):
        beyond[k:] &= inside[:-k]
        beyond[:k] = False
        heads = offsets[:-1] + k - 1
        beyond[heads[heads < len(data)]] = False
    cut[beyond] = 0x20
    words, bounds = word_hashes(data, offsets)
    stems, ends = word_hashes(cut, offsets)
    both = np.empty(len(words) + len(stems), np.uint64)
    shift = bounds + ends
    for source, at, first in ((words, bounds, shift[:-1]), (stems, ends, shift[:-1] + np.diff(bounds))):
        both[np.arange(len(source)) + np.repeat(first - at[:-1], np.diff(at))] = source
    return both, shift


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = mixed(out * np.uint64(ODD) + words[k : len(words) - n + 1 + k])
    return out


class Seeds:
    """Sorted n-gram hashes with a bit table before them."""

    BITS = 22

    def __init__(self, grams: np.ndarray):
        self.grams = np.unique(grams)
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[self.grams >> np.uint64(64 - self.BITS)] = True

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``grams`` that hold a seed, and the seeds' numbers."""
        at = np.flatnonzero(self.table[grams >> np.uint64(64 - self.BITS)])
        number = np.searchsorted(self.grams, grams[at])
        number[number == len(self.grams)] = 0
        same = self.grams[number] == grams[at]
        return at[same], number[same]
