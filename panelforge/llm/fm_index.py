"""An FM-index over sequences of small integers, vectorised over many patterns at once.

The Burrows-Wheeler transform sits in a wavelet matrix; backward search narrows all patterns'
suffix ranges together, and positions come from sampled suffix-array entries by LF steps.
"""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix array of ``seq`` by prefix doubling; a suffix that ends first sorts first."""
    n = len(seq)
    if n == 0:
        return np.zeros(0, np.int64)
    _, rank = np.unique(seq, return_inverse=True)
    rank, k = rank.astype(np.int64) + 1, 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] if k < n else 0
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([1], 1 + np.cumsum(key[1:] != key[:-1])))
        if new.max() == n or k >= n:
            return order
        rank, k = new, 2 * k


class WaveletMatrix:
    """rank(symbol, i): how often a symbol occurs before position i, for arrays of both."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int64))
            self.zeros.append(int(len(seq) - bit.sum()))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        begin, end = np.zeros_like(at), at
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            up = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            b, e = ones[begin], ones[end]
            begin, end = np.where(up, zeros + b, begin - b), np.where(up, zeros + e, end - e)
        return end - begin

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            up = ones[at + 1] - ones[at]
            symbol = symbol * 2 + up
            at = np.where(up == 1, zeros + ones[at], at - ones[at])
        return symbol


class FMIndex:
    """Index of a sequence over 1..sigma-1; 0 is the end mark, which it appends itself."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = 16):
        seq = np.concatenate((np.asarray(seq, np.int64), [0]))
        sa = suffix_array(seq)
        self.n = len(seq)
        self.bwt = WaveletMatrix(seq[sa - 1], sigma)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=sigma))))
        self.sampled = sa % sample == 0
        self.sampled_rank = np.concatenate(([0], np.cumsum(self.sampled)))
        self.sampled_at = sa[self.sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of equally long patterns, one in each row."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for symbol in patterns.T[::-1]:
            low, high = self.before[symbol] + self.bwt.rank(symbol, low), self.before[symbol] + self.bwt.rank(symbol, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows."""
        rows, steps = np.array(rows, np.int64), np.zeros(len(rows), np.int64)
        found = np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            hit = self.sampled[at]
            found[open_[hit]] = self.sampled_at[self.sampled_rank[at[hit]]] + steps[open_[hit]]
            open_ = open_[~hit]
            at = at[~hit]
            symbol = self.bwt.access(at)
            rows[open_] = self.before[symbol] + self.bwt.rank(symbol, at)
            steps[open_] += 1
        return found
