"""Words and their hashes for whole Arrow slices, in numpy.

A word is a maximal run of bytes other than space and \\t..\\r. All arithmetic is modulo 2**64:
a polynomial prefix hash gives each word's or line's hash as a difference of two prefix sums,
finished by a mixing step, so no Python loop runs over words.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finisher)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), kept while they are of moderate size."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 1 << 22:
            _powers[base] = have
    return have[:n]


class Words:
    """Words of a slice of documents: starts, ends (byte positions), first (of each document, one more at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        self.inside = inside = ~SPACE[data]
        heads = offsets[:-1][np.diff(offsets) > 0]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        start[heads] = inside[heads]
        end = np.zeros(n + 1, bool)
        end[1:] = inside
        end[1:n] &= ~inside[1:]
        cut = heads[heads > 0]
        end[cut] = inside[cut - 1]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end)
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self._sums: np.ndarray | None = None

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte spans; equal spans have equal hashes."""
        n = len(self.data)
        if self._sums is None:
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(BYTE[self.data] * powers(BASE, n), out=self._sums[1:])
        h = (self._sums[ends] - self._sums[starts]) * powers(INVERSE, n + 1)[starts]
        return mix(h + (ends - starts).astype(np.uint64))

    def documents(self) -> np.ndarray:
        """Each word's document."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Rolling hashes of all n-word windows, those across documents too; the caller leaves these out."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = words[:count].copy()
    for k in range(1, n):
        out *= np.uint64(BASE)
        out += words[k : k + count]
    return mix(out)
