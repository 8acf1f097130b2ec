"""An FM-index over a sequence of integer symbols: suffix array, wavelet ranks, backward search."""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of s in their order, by prefix doubling on those not yet apart."""
    n = len(s)
    rank = s.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    ordered = rank[order]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0)) + 1
    h = 1
    while True:
        same = np.concatenate((~first[1:], [False])) | ~first  # slots of order in groups of several
        slots = np.flatnonzero(same)
        if not len(slots):
            return order
        at = order[slots]
        behind = at + h
        key = rank[at] * np.int64(n + 2) + np.where(behind < n, rank[np.minimum(behind, n - 1)], 0)
        turn = np.argsort(key, kind="stable")
        at, key = at[turn], key[turn]
        order[slots] = at
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        first[slots] = fresh
        rank[at] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))] + 1
        h *= 2


class Wavelet:
    """Ranks and accesses in a sequence of symbols, by a wavelet matrix with packed bits."""

    def __init__(self, s: np.ndarray, symbols: int) -> None:
        self.levels = max(1, int(symbols - 1).bit_length())
        self.words: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (s >> level) & 1 == 1
            packed = np.packbits(np.concatenate((bit, np.zeros(-len(bit) % 64 + 64, dtype=bool))), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))[:-1])
            self.zeros.append(int(len(bit) - bit.sum()))
            s = np.concatenate((s[~bit], s[bit]))

    def _ones(self, j: int, i: np.ndarray) -> np.ndarray:
        word, off = i >> 6, (i & 63).astype(np.uint64)
        return self.before[j][word] + np.bitwise_count(self.words[j][word] & ((np.uint64(1) << off) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, *at: np.ndarray) -> list[np.ndarray]:
        """For each array of at: how often symbol occurs before it."""
        ends = [np.zeros_like(symbol), *at]
        for j in range(self.levels):
            bit = (symbol >> (self.levels - 1 - j)) & 1 == 1
            ones = [self._ones(j, i) for i in ends]
            ends = [np.where(bit, self.zeros[j] + o, i - o) for i, o in zip(ends, ones, strict=True)]
        return [e - ends[0] for e in ends[1:]]

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for j in range(self.levels):
            bit = ((self.words[j][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            ones = self._ones(j, at)
            at = np.where(bit == 1, self.zeros[j] + ones, at - ones)
            out = out * 2 + bit
        return out


class FMIndex:
    """Of a sequence of symbols 0 .. symbols - 1; keeps every stride-th position, none of the sequence itself."""

    def __init__(self, s: np.ndarray, symbols: int, stride: int = 16) -> None:
        text = np.concatenate((s.astype(np.int64) + 1, [0]))
        sa = suffix_array(text)
        self.n, self.stride = len(text), stride
        self.start = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols + 1))))
        self.bwt = Wavelet(text[sa - 1], symbols + 1)
        self.sampled = sa % stride == 0
        self.sample_at = np.cumsum(self.sampled) - 1
        self.samples = sa[self.sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lo, hi) of each pattern, a row of patterns of the given length: the suffixes that begin with it are lo .. hi - 1."""
        lo, hi = np.zeros(len(lengths), dtype=np.int64), np.full(len(lengths), self.n, dtype=np.int64)
        live = np.arange(len(lengths))
        for step in range(int(lengths.max(initial=0))):
            live = live[(lengths[live] > step) & (lo[live] < hi[live])]
            if not len(live):
                break
            c = patterns[live, lengths[live] - 1 - step].astype(np.int64) + 1
            a, b = self.bwt.rank(c, lo[live], hi[live])
            lo[live], hi[live] = self.start[c] + a, self.start[c] + b
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of the suffixes of the given ranks, by walking to a sampled one."""
        out, at, steps = np.zeros_like(rows), rows.copy(), np.zeros_like(rows)
        live = np.arange(len(rows))
        while len(live):
            hit = self.sampled[at[live]]
            done = live[hit]
            out[done] = self.samples[self.sample_at[at[done]]] + steps[done]
            live = live[~hit]
            c = self.bwt.access(at[live])
            (r,) = self.bwt.rank(c, at[live])
            at[live] = self.start[c] + r
            steps[live] += 1
        return out
