"""Rolling hashes and minimizers over arrays of code points."""

from __future__ import annotations

import functools

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bits of a position within one array; the other bits of a word hold the hash that orders positions.
POSITION_BITS = np.uint64(24)
LONGEST = 1 << 24


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = (np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n - 1, b, dtype=np.uint64)))) for b in (_BASE, _INVERSE))
    return up, down


class Hashes:
    """Hashes of any stretch of an array: the polynomial in code points modulo 2^64, mixed."""

    def __init__(self, points: np.ndarray) -> None:
        size = 1 << max(12, int(len(points)).bit_length())
        self.up, down = _powers(size)
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum((points.astype(np.uint64) + np.uint64(1)) * down[: len(points)], dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.up[:n] + np.uint64(k)) if n > 0 else np.zeros(0, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def window_minima(grams: np.ndarray, w: int) -> np.ndarray:
    """Of each w successive grams the position of the one with the least hash, the first of equal ones."""
    if len(grams) < w:
        return np.zeros(0, dtype=np.int64)
    low = (grams >> POSITION_BITS << POSITION_BITS) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[: len(grams) - w + 1], low[w - span :])
    return (low & ((np.uint64(1) << POSITION_BITS) - np.uint64(1))).astype(np.int64)


def minimizers(grams: np.ndarray, w: int) -> np.ndarray:
    """The positions that are the minimum of some w successive grams, in order."""
    m = window_minima(grams, w)
    return m[np.concatenate(([True], m[1:] != m[:-1]))] if len(m) else m
