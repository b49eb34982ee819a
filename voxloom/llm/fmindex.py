"""A compressed full-text index (FM-index) over sequences of words, with vectorised backward search.

The Burrows-Wheeler transform lies in a wavelet matrix: one packed bit vector for each bit of a word's
number, with ranks every 64 places. Many searches run side by side.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with rank."""

    def __init__(self, bits: np.ndarray) -> None:
        n = -(-(bits.size + 1) // 64) * 64
        padded = np.zeros(n, dtype=np.uint8)
        padded[: bits.size] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)].astype(np.int32)
        self.ones = int(self.before[-1])
        self.zeros = bits.size - self.ones

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)


class WaveletMatrix:
    """Ranks of symbols in a sequence of numbers below 2^levels."""

    def __init__(self, values: np.ndarray, levels: int) -> None:
        self.levels: list[Bits] = []
        for bit in range(levels - 1, -1, -1):
            ones = (values >> bit) & 1
            self.levels.append(Bits(ones.astype(np.uint8)))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of each symbol's first occurrence in the last level's order, and of those at ``lo`` and ``hi``."""
        first = np.zeros_like(lo)
        for k, bits in enumerate(self.levels):
            one = ((symbol >> (len(self.levels) - 1 - k)) & 1).astype(bool)
            moved = []
            for at in (first, lo, hi):
                r = bits.rank(at)
                moved.append(np.where(one, bits.zeros + r, at - r))
            first, lo, hi = moved
        return first, lo, hi


def suffix_array(text: np.ndarray, longest: int) -> np.ndarray:
    """Order of the suffixes by their first ``longest`` words at least (a separator, 0, ends each sequence)."""
    rank = text.astype(np.int64)
    size = 1
    while True:
        later = np.zeros_like(rank)
        if size < rank.size:
            later[:-size] = rank[size:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + later
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.r_[False, sorted_[1:] != sorted_[:-1]])
        size *= 2
        if size >= longest or int(rank.max(initial=0)) == rank.size - 1:
            return order


class FMIndex:
    """Index of sequences laid end to end; ``owners`` says whose each sequence is."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, owners: np.ndarray) -> None:
        self.alphabet, symbols = np.unique(words, return_inverse=True)
        ends = np.cumsum(sizes)
        # 0 separates sequences; words count from 1
        text = np.zeros(words.size + sizes.size, dtype=np.int64)
        text[np.arange(words.size) + np.repeat(np.arange(sizes.size), sizes)] = symbols + 1
        order = suffix_array(text, int(sizes.max(initial=0)) + 1)
        levels = max(1, int(self.alphabet.size).bit_length())
        self.matrix = WaveletMatrix(text[order - 1], levels)
        self.starts = np.searchsorted(np.sort(text), np.arange(self.alphabet.size + 2))
        self.size = text.size
        # least owner of any stretch of suffixes, by powers of two
        table = owners[np.minimum(np.searchsorted(ends + np.arange(1, sizes.size + 1), order, "right"), sizes.size - 1)]
        self.least = [table]
        while 2 << len(self.least) - 1 <= self.size:
            half = 1 << len(self.least) - 1
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def matching(self, words: np.ndarray, ends: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each end (a word's place): how many words up to it, at most ``longest``, are found, and the last interval.

        These are the matching statistics of the streamed words, cut at the length that matters.
        """
        at = np.minimum(np.searchsorted(self.alphabet, words), self.alphabet.size - 1)
        symbols = np.where(self.alphabet[at] == words, at + 1, 0)
        lo, hi = np.zeros(ends.size, dtype=np.int64), np.full(ends.size, self.size, dtype=np.int64)
        length, open_ = np.zeros(ends.size, dtype=np.int64), np.arange(ends.size)
        for step in range(longest):
            place = ends[open_] - step
            symbol = np.where(place >= 0, symbols[np.maximum(place, 0)], 0)
            first, a, b = self.matrix.rank(symbol, lo[open_], hi[open_])
            found = (symbol > 0) & (b > a)
            a, b = self.starts[symbol] + a - first, self.starts[symbol] + b - first
            open_ = open_[found]
            lo[open_], hi[open_] = a[found], b[found]
            length[open_] += 1
            if not open_.size:
                break
        return length, lo, hi

    def least_owner(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest owner among the suffixes of each interval (none may be empty)."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(lo.size, dtype=self.least[0].dtype)
        for k in np.unique(level).tolist():
            own = level == k
            out[own] = np.minimum(self.least[k][lo[own]], self.least[k][hi[own] - (1 << k)])
        return out
