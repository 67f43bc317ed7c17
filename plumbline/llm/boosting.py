"""Gradient-boosted trees for two classes: histogram splits, logistic loss, Newton leaf values."""

from __future__ import annotations

import numpy as np


class Boosted:
    """fit(x, y) then margin(x): the log-odds of class 1. Each tree sees a seeded share of the rows."""

    def __init__(self, trees: int = 150, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: float = 5.0, share: float = 0.4):
        self.n, self.depth, self.rate, self.bins, self.l2, self.least, self.share = trees, depth, rate, bins, l2, least, share

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, m = x.shape
        draw = np.random.default_rng(5)
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)
        w = self.bins + 1
        places = (binned + np.arange(m) * w).astype(np.int64)  # of a row's values in the histograms of one node
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        f, self.trees = np.full(n, self.base), []
        size = 2**self.depth
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-f))
            g, h = p - y, p * (1 - p)
            rows = np.flatnonzero(draw.random(n) < self.share)
            feature, cut = np.zeros(size, int), np.full(size, np.inf)
            at = np.ones(n, int)  # heap position; a node that isn't split sends all rows left
            gr, hr = np.repeat(g[rows], m), np.repeat(h[rows], m)
            own = places[rows]
            for level in range(self.depth):
                lo = 2**level
                flat = (own + ((at[rows] - lo) * (m * w))[:, None]).ravel()
                j, b = self.splits(np.bincount(flat, gr, lo * m * w).reshape(lo, m, w), np.bincount(flat, hr, lo * m * w).reshape(lo, m, w))
                for i in np.flatnonzero(j >= 0):
                    feature[lo + i], cut[lo + i] = j[i], self.edges[j[i]][b[i]]
                at = 2 * at + (x[np.arange(n), feature[at]] > cut[at])
            leaf = at - size
            value = -np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + self.l2)
            self.trees.append((feature, cut, self.rate * value))
            f = f + self.rate * value[leaf]
        return self

    def splits(self, sg: np.ndarray, sh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best (feature, bin) of every node from its histograms (node, feature, bin); feature -1 where no split gains."""
        nodes, m, w = sg.shape
        sg, sh = sg.cumsum(2), sh.cumsum(2)
        tg, th = sg[:, :, -1:], sh[:, :, -1:]
        gain = sg**2 / (sh + self.l2) + (tg - sg) ** 2 / (th - sh + self.l2) - tg**2 / (th + self.l2)
        limit = np.array([len(e) for e in self.edges])[:, None]
        gain[(np.arange(w)[None] >= limit)[None] | (sh < self.least / 4) | (th - sh < self.least / 4)] = -1
        best = gain.reshape(nodes, -1).argmax(1)
        found = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-3
        return np.where(found, best // w, -1), best % w

    def margin(self, x: np.ndarray) -> np.ndarray:
        f, r = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.ones(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + (x[r, feature[at]] > cut[at])
            f += value[at - 2**self.depth]
        return f
