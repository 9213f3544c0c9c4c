"""Gradient-boosted trees for a binary target, on quantile bins, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, Newton leaves, complete trees of fixed depth. Deterministic."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, least: float = 4.0, ridge: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        n, f = x.shape
        w = np.ones(n) if weight is None else weight
        edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(f)]
        binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)
        rate = np.clip((w * y).sum() / w.sum(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(n, self.base)
        inner = (1 << self.depth) - 1
        self.feature = np.zeros((self.trees, inner), np.int64)
        self.cut = np.full((self.trees, inner), np.inf)
        self.leaf = np.zeros((self.trees, inner + 1))
        size = self.bins + 1
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = w * (y - p), w * p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, wide = (1 << level) - 1, 1 << level
                best = np.zeros(wide)
                for k in range(f):
                    key = node * size + binned[:, k]
                    gs = np.bincount(key, g, wide * size).reshape(wide, size).cumsum(1)
                    hs = np.bincount(key, h, wide * size).reshape(wide, size).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(hs < self.least) | (ht - hs < self.least)] = 0
                    gain = gain[:, : len(edges[k])]
                    if gain.shape[1]:
                        at = gain.argmax(1)
                        top = gain[np.arange(wide), at]
                        better = np.flatnonzero(top > best + 1e-9)
                        best[better] = top[better]
                        self.feature[t, first + better] = k
                        self.cut[t, first + better] = edges[k][at[better]]
                where = first + node
                node = 2 * node + (x[np.arange(n), self.feature[t, where]] > self.cut[t, where])
            gs, hs = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
            self.leaf[t] = self.rate * gs / (hs + self.ridge)
            score += self.leaf[t, node]
        return self

    def decision(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                where = (1 << level) - 1 + node
                node = 2 * node + (x[rows, self.feature[t, where]] > self.cut[t, where])
            score += self.leaf[t, node]
        return score
