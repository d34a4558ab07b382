"""Suffix arrays by induced sorting, and permuted common prefixes, in whole-array steps.

Suffixes are classified as smaller or larger than their successor.  Sorting the leftmost smaller ones
(LMS) induces all others in two linear passes over the buckets.  The LMS substrings are sorted by the same
induction, named, and the suffixes of the string of names are sorted in turn, by doubling, as its alphabet
is too large for buckets.  A bucket is handled in rounds: all suffixes of a round induce at once.
"""

from __future__ import annotations

import numpy as np


def classify(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one that follows it; the last one is larger."""
    n = len(s)
    rising = np.zeros(n, np.int8)
    rising[:-1] = np.sign(s[1:].astype(np.int32) - s[:-1].astype(np.int32))
    rising[-1] = -1
    # Equal neighbours take the class of the next change.
    at = np.where(rising != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return rising[at] > 0


def _deal(queues: list[list], positions: np.ndarray, symbols: np.ndarray) -> None:
    """Appends positions to their symbols' queues, in order."""
    if len(positions) == 0:
        return
    order = np.argsort(symbols, kind="stable")
    positions, symbols = positions[order], symbols[order]
    cut = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    for symbol, part in zip(symbols[np.concatenate(([0], cut))].tolist(), np.split(positions, cut), strict=True):
        queues[symbol].append(part)


def _join(parts: list) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def induce(s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array induced by LMS suffixes given in order (by their substrings: ordered by those)."""
    n = len(s)
    seeds: list[list] = [[] for _ in range(sigma)]
    _deal(seeds, lms, s[lms])
    larger: list[list] = [[] for _ in range(sigma)]
    larger[int(s[-1])].append(np.array([n - 1]))  # induced by the end of the text
    ready = []
    for c in range(sigma):
        done, turn = [], _join(larger[c])
        while len(turn):
            done.append(turn)
            before = turn[turn > 0] - 1
            symbol = s[before]
            _deal(larger, before[symbol > c], symbol[symbol > c])
            turn = before[symbol == c]
        ready.append(_join(done))
        before = _join(seeds[c])
        before = before[before > 0] - 1
        _deal(larger, before, s[before])
    smaller: list[list] = [[] for _ in range(sigma)]
    out: list = [None] * sigma
    for c in range(sigma - 1, -1, -1):
        done, turn = [], _join(smaller[c])
        while len(turn):
            done.append(turn)
            before = turn[turn > 0] - 1
            symbol = s[before]
            _deal(smaller, before[symbol < c], symbol[symbol < c])
            turn = before[symbol == c]
        before = ready[c][::-1]
        before = before[before > 0] - 1
        symbol = s[before]
        _deal(smaller, before[symbol < c], symbol[symbol < c])
        out[c] = np.concatenate((ready[c], _join(done)[::-1]))
    return np.concatenate(out)


def _sort_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, which are below its length.

    A rank is the place where its group of suffixes that agree so far begins; only groups of several are sorted on.
    """
    n, k = len(names), 1
    counts = np.bincount(names)
    rank = (np.cumsum(counts) - counts)[names]
    tied = np.flatnonzero(counts[names] > 1)
    while len(tied):
        after = tied + k
        # The end is less than any name.
        key = rank[tied] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key)  # equal keys share a rank, so their order does not matter
        key, tied = key[order], tied[order]
        old = key // (n + 1)
        place = np.arange(len(key))
        group = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), place, 0))
        edge = np.append(True, key[1:] != key[:-1])
        rank[tied] = old + np.maximum.accumulate(np.where(edge, place, 0)) - group
        tied, k = tied[~(edge & np.append(edge[1:], True))], 2 * k
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def suffix_array(s: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of symbols below ``sigma``."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    s = s.astype(np.uint16)
    small = classify(s)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(is_lms)
    if len(lms) == 0:
        return induce(s, lms, sigma)
    by_substring = induce(s, lms, sigma)
    by_substring = by_substring[is_lms[by_substring]]
    # Equal LMS substrings get one name.  Each reaches to the next LMS suffix, or to the end.
    index = np.empty(n, np.int64)
    index[lms] = np.arange(len(lms))
    stop = np.append(lms[1:] + 1, n)
    length = stop - lms
    a, b = by_substring[:-1], by_substring[1:]
    same = length[index[a]] == length[index[b]]
    same &= index[a] != len(lms) - 1
    same &= index[b] != len(lms) - 1
    open_, step = np.flatnonzero(same), 0
    while len(open_):
        x, y = a[open_], b[open_]
        equal = s[x + step] == s[y + step]
        same[open_[~equal]] = False
        open_ = open_[equal]
        step += 1
        open_ = open_[length[index[a[open_]]] > step]
    names = np.empty(len(lms), np.int64)
    names[index[by_substring]] = np.concatenate(([0], np.cumsum(~same)))
    return induce(s, lms[_sort_names(names)], sigma)


def permuted_lcp(text: np.ndarray, sa: np.ndarray, most: int, block: int = 16) -> np.ndarray:
    """For each text position the common prefix with its predecessor in ``sa``, up to ``most`` bytes.

    In text order the value falls by at most one from a position to the next, so each block of positions
    carries it along; all blocks advance together, eight bytes in a comparison.  That holds for a whole order only,
    not for one by so many first symbols: ``sa`` must be exact.
    """
    n = len(text)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    padded = np.concatenate((text, np.zeros(most + 16, np.uint8)))
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (n + most + 8, 8), (1, 1))
    out = np.zeros(n, np.int64)
    start = np.arange(0, n, block)
    carried = np.zeros(len(start), np.int64)
    for step in range(block):
        at = start + step
        inside = at < n
        at, carried, start = at[inside], carried[inside], start[inside]
        carried = np.maximum(carried - 1, 0)
        other = before[at]
        carried[other < 0] = 0
        active = np.flatnonzero((other >= 0) & (carried < most))
        while len(active):
            p, q = at[active] + carried[active], other[active] + carried[active]
            apart = (words[p].view("<u8") ^ words[q].view("<u8")).ravel()
            carried[active] += np.where(apart == 0, 8, np.bitwise_count((apart & (~apart + np.uint64(1))) - np.uint64(1)) // 8)
            active = active[(apart == 0) & (carried[active] < most)]
        carried = np.minimum(carried, np.minimum(most, n - np.maximum(at, other)))
        out[at] = carried
    return out
