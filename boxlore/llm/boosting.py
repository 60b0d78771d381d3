"""Gradient-boosted trees for a binary label, in numpy: binned features, depth-limited trees, Newton leaf values."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting. Trees are complete binary trees of ``depth`` levels over features cut into at most 32 bins."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.ridge = trees, depth, rate, ridge

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(self.cuts)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = []
        for k in range(x.shape[1]):
            seen = np.unique(x[:, k])
            middle = (seen[1:] + seen[:-1]) / 2
            self.cuts.append(middle if len(middle) <= 31 else np.unique(np.quantile(x[:, k], np.linspace(0, 1, 33)[1:-1])))
        b, width = self._bins(x), 32
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score = np.full(len(y), self.base)
        nodes = 2**self.depth - 1
        self.feature = np.zeros((self.trees, nodes), np.int64)
        self.cut = np.full((self.trees, nodes), width)
        self.leaf = np.zeros((self.trees, nodes + 1))
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            at = np.zeros(len(y), np.int64)  # node within its level
            for level in range(self.depth):
                n = 2**level
                best = np.full(n, 1e-9)
                for f in range(x.shape[1]):
                    cell = at * width + b[:, f]
                    gs, hs = (np.bincount(cell, w, n * width).reshape(n, width).cumsum(1) for w in (g, h))
                    gain = gs**2 / (hs + self.ridge) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + self.ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + self.ridge)
                    top = gain.argmax(1)
                    better = gain[np.arange(n), top] > best
                    best = np.where(better, gain[np.arange(n), top], best)
                    node = n - 1 + np.flatnonzero(better)
                    self.feature[t, node], self.cut[t, node] = f, top[better]
                node = n - 1 + at
                at = 2 * at + (b[np.arange(len(y)), self.feature[t, node]] > self.cut[t, node])
            self.leaf[t] = self.rate * np.bincount(at, g, nodes + 1) / (np.bincount(at, h, nodes + 1) + self.ridge)
            score += self.leaf[t][at]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        if not len(x):
            return np.zeros(0)
        b, rows = self._bins(x), np.arange(len(x))
        score = np.full(len(x), self.base)
        for t in range(self.trees):
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = 2**level - 1 + at
                at = 2 * at + (b[rows, self.feature[t, node]] > self.cut[t, node])
            score += self.leaf[t][at]
        return 1 / (1 + np.exp(-score))


def threshold_for_precision(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The smallest probability from which on predictions reach ``precision`` on rows that were not trained on."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(right >= precision)
    return float(p[order[good[-1]]]) if len(good) else 1.0
