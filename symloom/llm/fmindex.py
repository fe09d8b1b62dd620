"""A full-text index of integer symbols: BWT, wavelet matrix, sampled suffix positions. All queries run in blocks."""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of s (symbols below 2**21 - 1) in order; the end of s is less than every symbol.

    The first three symbols are sorted as one number, then prefixes double; only suffixes that still tie are sorted."""
    n = len(s)
    padded = np.concatenate([s.astype(np.int64) + 1, np.zeros(2, np.int64)])
    key = padded[:n] << 42 | padded[1 : n + 1] << 21 | padded[2 : n + 2]
    order = np.argsort(key)
    places = np.arange(n)
    group = places.copy()  # the first place of each group of ties, by place
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if n else np.zeros(0, bool)
    group = np.maximum.accumulate(np.where(new, places, 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    width = 3
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at) or width >= n:
            return order
        sub = order[at]
        nxt = np.zeros(len(sub), np.int64)
        inside = sub + width < n
        nxt[inside] = rank[sub[inside] + width] + 1
        key = rank[sub] * (n + 1) + nxt
        o = np.argsort(key)
        sub, key = sub[o], key[o]
        order[at] = sub
        first = np.concatenate([[True], key[1:] != key[:-1]])
        new[at] = first
        rank[sub] = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        width *= 2


class WaveletMatrix:
    def __init__(self, s: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        s = s.copy()
        for b in range(bits - 1, -1, -1):
            bit = (s >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(s) - bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands before position i."""
        lo = np.zeros_like(i)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            one = (c >> b) & 1 == 1
            r_lo, r_hi = self.ones[level][lo], self.ones[level][i]
            lo = np.where(one, self.zeros[level] + r_lo, lo - r_lo)
            i = np.where(one, self.zeros[level] + r_hi, i - r_hi)
        return i - lo


class FMIndex:
    """Index of one shard; symbols are 1 or more."""

    SAMPLE = 8

    def __init__(self, s: np.ndarray, largest: int):
        s = np.concatenate([s, [0]]).astype(np.int64)
        self.n = len(s)
        order = suffix_array(s)
        self.bwt = s[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=largest + 1))])
        self.wavelet = WaveletMatrix(self.bwt, max(1, int(largest).bit_length()))
        self.sampled = np.where(order % self.SAMPLE == 0, order, -1)

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the rows [lo, hi) that begin with each phrase (a row of the matrix)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, k]
            lo, hi = self.first[c] + self.wavelet.rank(c, lo), self.first[c] + self.wavelet.rank(c, hi)
            hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by stepping back to a sampled one."""
        rows, at, steps = rows.astype(np.int64), np.full(len(rows), -1, np.int64), 0
        todo = np.arange(len(rows))
        while len(todo):
            known = self.sampled[rows]
            done = known >= 0
            at[todo[done]] = known[done] + steps
            todo, rows = todo[~done], rows[~done]
            c = self.bwt[rows]
            rows = self.first[c] + self.wavelet.rank(c, rows)
            steps += 1
        return at
