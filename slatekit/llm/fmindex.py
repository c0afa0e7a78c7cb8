"""FM-index over integer texts, in numpy: suffix order by prefix doubling,
wavelet-matrix ranks, backward search of many patterns at once, and location by
sampled suffix positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 4


def suffix_order(runs: np.ndarray) -> np.ndarray:
    """Suffix array of symbols >= 0.  Every 0 ends a run and counts as a symbol
    of its own, so suffixes differ within a run and doubling ends there."""
    n = len(runs)
    ends = np.flatnonzero(runs == 0)
    rank = runs.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    k = 1
    order = np.argsort(rank, kind="stable")
    while True:
        s = rank[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(s[1:] != s[:-1])))
        rank = new
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        nxt = np.zeros(n, np.int64)
        nxt[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + nxt
        # only suffixes that still tie are sorted again, inside their tie
        r = rank[order]
        tie = np.zeros(n, bool)
        same = r[1:] == r[:-1]
        tie[1:] |= same
        tie[:-1] |= same
        at = np.flatnonzero(tie)
        part = order[at]
        order[at] = part[np.argsort(key[part], kind="stable")]
        rank = key
        k *= 2


class FMIndex:
    """Index of a text of runs, each ended by a 0; pattern symbols are >= 1."""

    def __init__(self, runs: np.ndarray, sigma: int, sample: int = SAMPLE):
        self.n = n = len(runs)
        order = suffix_order(runs)
        bwt = runs[order - 1]                     # order 0 wraps to the last 0
        self.first = np.concatenate(([0], np.cumsum(np.bincount(runs, minlength=sigma + 1))))
        self.levels = max(1, int(sigma).bit_length())
        self.bits, self.zeros = [], []
        row = bwt.astype(np.int64)
        for lv in range(self.levels - 1, -1, -1):
            b = (row >> lv) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(b, out=ones[1:])
            self.bits.append(ones)
            self.zeros.append(n - int(ones[-1]))
            row = np.concatenate((row[b == 0], row[b == 1]))
        # sampled positions: every `sample`-th one and every start of a run
        start = np.ones(n, bool)
        start[1:] = runs[:-1] == 0
        kept = start[order] | (order % sample == 0)
        self.kept = np.zeros(n + 1, np.int32)
        np.cumsum(kept, out=self.kept[1:])
        self.samples = order[kept]

    def rank(self, sym: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Occurrences of ``sym`` in the transform before ``pos``."""
        lo = np.zeros_like(pos)
        for i, (ones, z) in enumerate(zip(self.bits, self.zeros)):
            up = (sym >> (self.levels - 1 - i)) & 1 == 1
            lo = np.where(up, z + ones[lo], lo - ones[lo])
            pos = np.where(up, z + ones[pos], pos - ones[pos])
        return pos - lo

    def symbol(self, pos: np.ndarray) -> np.ndarray:
        sym = np.zeros_like(pos)
        for ones, z in zip(self.bits, self.zeros):
            up = ones[pos + 1] > ones[pos]
            sym = sym * 2 + up
            pos = np.where(up, z + ones[pos], pos - ones[pos])
        return sym

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of the rows of ``patterns`` (m x length)."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            s = patterns[live, j]
            base = self.first[s]
            lo[live], hi[live] = base + self.rank(s, lo[live]), base + self.rank(s, hi[live])
            live = live[hi[live] > lo[live]]
            if not len(live):
                break
        return lo, np.maximum(lo, hi)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks ``at``: steps back to a sample."""
        at, out = at.copy(), np.empty(len(at), np.int64)
        todo, steps = np.arange(len(at)), 0
        while len(todo):
            p = at[todo]
            hit = self.kept[p + 1] > self.kept[p]
            out[todo[hit]] = self.samples[self.kept[p[hit]]] + steps
            todo, p = todo[~hit], p[~hit]
            s = self.symbol(p)
            at[todo] = self.first[s] + self.rank(s, p)
            steps += 1
        return out
