"""FM-indexes over sequences of small integers, searched for many patterns at once.

The Burrows-Wheeler transform is kept in a wavelet matrix: one bit per symbol and level, with a count of ones per 64
bits. The suffix array is needed to build it and then dropped. All searches take arrays of intervals, so that a step of
all patterns is a handful of array operations.
"""

from __future__ import annotations

import numpy as np

WORD = np.uint64(63)
ONE = np.uint64(1)


class WaveletMatrix:
    """Ranks in a sequence of numbers from 0 to ``sigma`` - 1, in log2(sigma) steps each."""

    def __init__(self, sequence: np.ndarray, sigma: int) -> None:
        self.levels = max(int(sigma - 1).bit_length(), 1)
        self.words: list[np.ndarray] = []
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        rest = np.asarray(sequence, np.int64)
        for level in reversed(range(self.levels)):
            bits = (rest >> level) & 1
            self.words.append(pack(bits))
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(self.words[-1]), dtype=np.int64)]))
            high = bits.astype(bool)
            self.zeros.append(len(rest) - int(high.sum()))
            rest = np.concatenate([rest[~high], rest[high]])
        #: where the run of each symbol begins behind the last level
        symbols = np.arange(sigma)
        self.first = self._walk(symbols, np.zeros(sigma, np.int64))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones in front of each place."""
        word, bit = at >> 6, at.astype(np.uint64) & WORD
        return self.ones[level][word] + np.bitwise_count(self.words[level][word] & ((ONE << bit) - ONE))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            high = (symbols >> (self.levels - 1 - level)) & 1
            ones = self._ones(level, at)
            at = np.where(high == 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in front of each place."""
        return self._walk(symbols, at) - self.first[symbols]

    def ranks_and_smaller(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranks at both ends of each interval, and how many smaller symbols the interval holds."""
        smaller = np.zeros(len(symbols), np.int64)
        for level in range(self.levels):
            up = (symbols >> (self.levels - 1 - level)) & 1 == 1
            a, b = self._ones(level, low), self._ones(level, high)
            smaller += np.where(up, (high - b) - (low - a), 0)
            low, high = np.where(up, self.zeros[level] + a, low - a), np.where(up, self.zeros[level] + b, high - b)
        first = self.first[symbols]
        return low - first, high - first, smaller


def pack(bits: np.ndarray) -> np.ndarray:
    """Bits as 64-bit words, the first one lowest, with a word to spare for places at the end."""
    padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
    padded[: len(bits)] = bits
    return np.packbits(padded, bitorder="little").view(np.uint64)


def suffix_order(sequence: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Starts of the suffixes in order, of all symbols or of the first ``depth`` at least, by doubling."""
    n = len(sequence)
    rank = np.unique(sequence, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    span = 1
    while rank.max() + 1 < n and (depth is None or span < depth):
        behind = np.zeros(n, np.int64)
        behind[: max(n - span, 0)] = rank[span:] + 1
        key = rank * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        span *= 2
    return order


class FMIndex:
    """Index of a sequence whose symbols are 1 to ``sigma`` - 1; 0 ends it.

    ``depth`` bounds the length of the patterns that may be searched, and the sorting to as much.
    """

    def __init__(self, sequence: np.ndarray, sigma: int, depth: int | None = None) -> None:
        ended = np.concatenate([np.asarray(sequence, np.int64), [0]])
        self.size = len(ended)
        self.bwt = WaveletMatrix(ended[suffix_order(ended, depth) - 1], sigma)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(ended, minlength=sigma))])

    def all(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the empty pattern, ``count`` times."""
        return np.zeros(count, np.int64), np.full(count, self.size, np.int64)

    def before(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol in front (backward search)."""
        start = self.start[symbols]
        return start + self.bwt.rank(symbols, low), start + self.bwt.rank(symbols, high)


class BidirectionalIndex:
    """Index of a sequence and of its reverse. A pattern is (low, other, size): its interval among the suffixes, the
    start of its interval among the reversed prefixes, and their common size; it grows at either end."""

    def __init__(self, sequence: np.ndarray, sigma: int) -> None:
        self.ahead, self.back = FMIndex(sequence, sigma), FMIndex(sequence[::-1], sigma)

    def all(self, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(count, np.int64), np.zeros(count, np.int64), np.full(count, self.ahead.size, np.int64)

    def left(self, symbols: np.ndarray, low: np.ndarray, other: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One more symbol in front of each pattern."""
        a, b, smaller = self.ahead.bwt.ranks_and_smaller(symbols, low, low + size)
        return self.ahead.start[symbols] + a, other + smaller, b - a

    def right(self, symbols: np.ndarray, low: np.ndarray, other: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One more symbol behind each pattern."""
        a, b, smaller = self.back.bwt.ranks_and_smaller(symbols, other, other + size)
        return low + smaller, self.back.start[symbols] + a, b - a
