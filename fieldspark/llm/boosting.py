"""Gradient-boosted trees for two classes over binned features (numpy)."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Trees of fixed depth as arrays; ``probability`` walks all rows through all trees at once."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, l2: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.l2 = trees, depth, rate, l2
        self.edges: list[np.ndarray] = []
        self.feature: list[np.ndarray] = []
        self.cut: list[np.ndarray] = []
        self.leaf: list[np.ndarray] = []
        self.start = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, dtype=np.uint8)
        for j, edges in enumerate(self.edges):
            out[:, j] = np.searchsorted(edges, x[:, j], side="left")
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        points = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(column, points)) for column in x.T]
        binned = self._binned(x)
        mean = np.average(y, weights=weight)
        self.start = float(np.log(mean / (1 - mean))) if 0 < mean < 1 else 0.0
        score = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            gradient, hessian = weight * (y - p), weight * p * (1 - p)
            node = np.zeros(len(y), dtype=np.int64)
            feature = np.zeros((1 << self.depth) - 1, dtype=np.int64)
            cut = np.full((1 << self.depth) - 1, 255, dtype=np.int64)
            for level in range(self.depth):
                first, count = (1 << level) - 1, 1 << level
                local = node - first
                best = np.full(count, 1e-9)
                for j in range(x.shape[1]):
                    slot = local * BINS + binned[:, j]
                    g = np.bincount(slot, gradient, count * BINS).reshape(count, BINS).cumsum(axis=1)
                    h = np.bincount(slot, hessian, count * BINS).reshape(count, BINS).cumsum(axis=1)
                    g_all, h_all = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + self.l2) + (g_all - g) ** 2 / (h_all - h + self.l2)
                    gain -= g_all**2 / (h_all + self.l2)
                    at = gain[:, :-1].argmax(axis=1)
                    value = gain[np.arange(count), at]
                    better = value > best
                    best[better] = value[better]
                    feature[first : first + count][better] = j
                    cut[first : first + count][better] = at[better]
                node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node])
            local = node - ((1 << self.depth) - 1)
            leaf = np.bincount(local, gradient, 1 << self.depth) / (
                np.bincount(local, hessian, 1 << self.depth) + self.l2
            )
            leaf *= self.rate
            score += leaf[local]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(leaf)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        rows = np.arange(len(x))
        score = np.full(len(x), self.start)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            score += leaf[node - ((1 << self.depth) - 1)]
        return 1 / (1 + np.exp(-score))
