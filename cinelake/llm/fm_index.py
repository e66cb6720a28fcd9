"""Compressed FM-index over a text of integer symbols: a wavelet matrix of the Burrows-Wheeler transform.

Suffixes are sorted by their first ``depth`` symbols only, which is all that patterns of up to ``depth`` symbols need.
All patterns of one length are searched at once, backwards, symbol by symbol.
"""

from __future__ import annotations

import numpy as np


class BitRank:
    """A bit vector packed into 64-bit words with the number of ones before every word."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class WaveletMatrix:
    """Rank of any symbol at any position, one bit vector per bit of the symbols, highest first."""

    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        self.levels: list[tuple[int, BitRank, int]] = []
        rows = symbols
        start = np.zeros(n_symbols, np.int64)
        codes = np.arange(n_symbols)
        for shift in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            bits = ((rows >> shift) & 1).astype(np.uint8)
            rank, zeros = BitRank(bits), int(len(bits) - np.count_nonzero(bits))
            self.levels.append((shift, rank, zeros))
            ones = rank.ones(start)
            start = np.where((codes >> shift) & 1 == 1, zeros + ones, start - ones)
            rows = np.concatenate([rows[bits == 0], rows[bits == 1]])
        self.start = start  # where each symbol's occurrences begin below the last level

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before the position beside it."""
        for shift, bits, zeros in self.levels:
            ones = bits.ones(i)
            i = np.where((symbol >> shift) & 1 == 1, zeros + ones, i - ones)
        return i - self.start[symbol]


class FMIndex:
    """Index of a text whose symbols are 0 (separator) to ``n_symbols`` - 1."""

    def __init__(self, text: np.ndarray, n_symbols: int, depth: int) -> None:
        order, h = text.astype(np.int64), 1
        self.depth, self.half = depth, (order, 1)
        while h < depth:  # order of the first h symbols of every suffix, doubled
            if h * 2 >= depth:
                self.half = (order, h)
            following = np.zeros(len(text), np.int64)
            following[:-h or None] = order[h:] + 1
            _, order = np.unique(order * (len(text) + n_symbols + 2) + following, return_inverse=True)
            h *= 2
        self.suffixes = np.argsort(order, kind="stable")
        self.wavelet = WaveletMatrix(text[self.suffixes - 1], n_symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])

    def distinct(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One place for each different run of ``depth`` symbols at ``places``, and which of them each place has.

        A run is known by the ranks of overlapping shorter runs that cover it.
        """
        rank, h = self.half
        offsets = [*range(0, self.depth - h, h), self.depth - h]
        key = rank[places]
        for k in offsets[1:]:
            _, key = np.unique(key * (int(rank.max()) + 1) + rank[places + k], return_inverse=True)
        _, one, which = np.unique(key, return_index=True, return_inverse=True)
        return places[one], which

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval [lo, hi) of the suffixes that start with each row of ``patterns`` (at most ``depth`` symbols)."""
        n, width = patterns.shape
        symbol = patterns[:, width - 1]
        ends = np.concatenate([self.first[symbol], self.first[symbol + 1]])
        for k in range(width - 2, -1, -1):
            symbol = np.concatenate([patterns[:, k], patterns[:, k]])
            ends = self.first[symbol] + self.wavelet.rank(symbol, ends)
        return ends[:n], ends[n:]


def least_in(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of ``values[lo:hi]`` per interval; intervals are equal or disjoint and not empty."""
    starts, which = np.unique(lo, return_inverse=True)
    ends = np.zeros(len(starts), np.int64)
    ends[which] = hi
    bounds = np.ravel(np.column_stack([starts, ends]))
    return np.minimum.reduceat(np.append(values, values.max()), bounds)[::2][which]
