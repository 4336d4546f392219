"""Gradient-boosted trees for two classes, on binned features."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of one depth, each fitted to the gradient of the log loss; a leaf's value is its Newton step. A tree's
    splits come from a share of the rows and of the features, drawn from a seed; its leaves from all rows."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, least: float = 5.0, shrink: float = 1.0, rows: float = 1.0, features: float = 1.0, seed: int = 0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.shrink = trees, depth, rate, bins, least, shrink
        self.rows, self.features, self.seed = rows, features, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, k = x.shape
        grid = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], grid, method="lower")) for j in range(k)]
        binned = self._bin(x)
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.start = float(np.log(share / (1 - share)))
        inner, leaves = (1 << self.depth) - 1, 1 << self.depth
        self.feature = np.zeros((self.trees, inner), np.int32)
        self.split = np.full((self.trees, inner), self.bins, np.int32)
        self.value = np.zeros((self.trees, leaves))
        score = np.full(n, self.start)
        rng, most = np.random.default_rng(self.seed), max(1, round(k * self.features))
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            some = np.flatnonzero(rng.random(n) < self.rows)
            cols = np.sort(rng.permutation(k)[:most])
            flat = binned[np.ix_(some, cols)] + np.arange(most, dtype=np.int32) * self.bins
            own_grad, own_hess = np.repeat(grad[some], most), np.repeat(hess[some], most)
            for level in range(self.depth):
                width = 1 << level
                at = (node[some, None].astype(np.int32) * (most * self.bins) + flat).ravel()
                size = width * most * self.bins
                g = np.bincount(at, own_grad, size).reshape(width, most, self.bins).cumsum(2)
                h = np.bincount(at, own_hess, size).reshape(width, most, self.bins).cumsum(2)
                gt, ht = g[:, :, -1:], h[:, :, -1:]
                gain = g**2 / (h + self.shrink) + (gt - g) ** 2 / (ht - h + self.shrink) - gt**2 / (ht + self.shrink)
                gain[(h < self.least) | (ht - h < self.least)] = 0
                best = gain.reshape(width, -1).argmax(1)
                useful = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
                first = width - 1
                self.feature[t, first : first + width] = np.where(useful, cols[best // self.bins], 0)
                self.split[t, first : first + width] = np.where(useful, best % self.bins, self.bins)
                node = 2 * node + (binned[np.arange(n), self.feature[t, first + node]] > self.split[t, first + node])
            g, h = np.bincount(node, grad, leaves), np.bincount(node, hess, leaves)
            self.value[t] = self.rate * g / (h + self.shrink)
            score += self.value[t, node]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1).astype(np.int16)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The chance of class 1 for each row."""
        binned, n = self._bin(x), len(x)
        score, rows = np.full(n, self.start), np.arange(n)
        for t in range(self.trees):
            node = np.zeros(n, np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (binned[rows, self.feature[t, node]] > self.split[t, node])
            score += self.value[t, node - (1 << self.depth) + 1]
        return 1 / (1 + np.exp(-score))
