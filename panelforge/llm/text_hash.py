"""Vectorised hashes of words and of byte windows.

A polynomial prefix sum over randomised byte values, modulo 2**64, gives the hash of any window as a
difference; two independent sets of byte values give 128 bits.  Texts are handled in pieces, so the
arrays stay small whatever the length of a text.
"""

from __future__ import annotations

from functools import cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes for which powers are kept; a longer piece computes its own.
PIECE = 1 << 20


@cache
def _powers(inverse: bool, n: int) -> np.ndarray:
    base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@cache
def _byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(1000 + seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Windows:
    """Hashes of windows of a byte array."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        n = len(data)
        size = max(PIECE, 1 << int(n).bit_length())
        self.inverse = _powers(True, size)
        self.sums = np.empty(n + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(_byte_values(seed)[data] * _powers(False, size)[:n], out=self.sums[1:])

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start])

    def every(self, width: int) -> np.ndarray:
        """Of the window of ``width`` bytes from each position that has one."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than ASCII white space."""
    step = np.diff(np.concatenate(([0], (~_SPACE[data]).view(np.int8), [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word between ASCII white space."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):  # a piece ends after a space, or takes in the whole of a longer word
            cut = max(text.rfind(s, at, end) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut < 0:
                later = [i for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (i := text.find(s, end)) >= 0]
                cut = min(later, default=len(text) - 1)
            end = cut + 1
        data = np.frombuffer(text, np.uint8, end - at, at)
        out.append(Windows(data).hash(*word_bounds(data)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)
