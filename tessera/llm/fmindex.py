"""A compressed FM-index over integer sequences: suffix order to a depth, BWT, wavelet matrix.

Suffixes are ordered by their first 2**r >= depth symbols, which is all that a
backward search of patterns of up to depth symbols needs.  The BWT lies in a
wavelet matrix: a bit vector with block counts for each bit of a symbol, so a
rank takes one popcount a level.  All searches of a batch advance together.
"""

from __future__ import annotations

import numpy as np


class BitRank:
    """Bits with the number of ones before each 64-bit block."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.blocks = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.blocks) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.blocks), out=self.before[1:])

    def __call__(self, i: np.ndarray) -> np.ndarray:
        block = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.blocks[block] & low)


class WaveletMatrix:
    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = []
        self.width = max(1, int(sigma - 1).bit_length())
        for shift in range(self.width - 1, -1, -1):
            bits = ((seq >> shift) & 1).astype(np.uint8)
            rank = BitRank(bits)
            zeros = len(seq) - int(bits.sum())
            self.levels.append((shift, rank, zeros))
            seq = np.concatenate([seq[bits == 0], seq[bits == 1]])
        self.first = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, rank, zeros in self.levels:
            ones = rank(i)
            i = np.where((symbol >> shift) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position i."""
        return self._walk(symbol, i) - self.first[symbol]


class FMIndex:
    """Over a sequence of symbols 0 .. sigma - 1, of which 0 separates texts."""

    def __init__(self, seq: np.ndarray, sigma: int, depth: int):
        n = len(seq)
        rank, reach = seq.astype(np.int64), 1
        while reach < depth:
            after = np.zeros(n, np.int64)
            after[:-reach] = rank[reach:] + 1 if reach < n else 0
            rank = np.unique((rank << 32) | after, return_inverse=True)[1]
            reach *= 2
        self.order = np.argsort(rank, kind="stable")
        self.depth, self.n = reach, n
        self.before = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(seq, minlength=sigma), out=self.before[1:])
        self.bwt = WaveletMatrix(seq[self.order - 1], sigma)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of a matrix of symbols (-1 to the left fills short patterns): its interval of suffixes."""
        length, lo, hi = self.statistics(patterns)
        return lo, np.where(length == (patterns >= 0).sum(axis=1), hi, lo)

    def statistics(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics at the rows' ends: the length of the longest suffix of each row that the index holds, and its interval."""
        m = len(patterns)
        lo, hi, length = np.zeros(m, np.int64), np.full(m, self.n, np.int64), np.zeros(m, np.int64)
        going = np.arange(m)
        for t in range(patterns.shape[1] - 1, -1, -1):
            going = going[patterns[going, t] >= 0]
            c = patterns[going, t]
            a, z = self.before[c] + self.bwt.rank(np.concatenate([c, c]), np.concatenate([lo[going], hi[going]])).reshape(2, -1)
            on = a < z
            going = going[on]
            lo[going], hi[going], length[going] = a[on], z[on], length[going] + 1
        return length, lo, hi


def matching_statistics(index: FMIndex, pattern: np.ndarray) -> np.ndarray:
    """For each place of the pattern, the length of the longest run that ends there and occurs in the index, up to its depth."""
    padded = np.concatenate([np.full(index.depth - 1, -1), pattern])
    return index.statistics(np.lib.stride_tricks.sliding_window_view(padded, index.depth))[0]
