"""Small gradient-boosted trees for binary labels, on binned features."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, second-order gains, trees of fixed depth stored as arrays."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.3, bins: int = 32, penalty: float = 1.0, least: float = 2.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.penalty, self.least = trees, depth, rate, bins, penalty, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = self._binned(x)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        raw = np.full(len(y), self.base)
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(binned, p - y, p * (1 - p))
            self.nodes.append(tree)
            raw += self._values(tree, binned)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)], axis=1).astype(np.int16)

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, dtype=np.int16), np.zeros(size)
        place = np.zeros(len(g), dtype=np.int64)
        for node in range(size):
            own = np.flatnonzero(place == node)
            if not len(own):
                continue
            sum_g, sum_h = g[own].sum(), h[own].sum()
            value[node] = -self.rate * sum_g / (sum_h + self.penalty)
            if node >= 2**self.depth - 1:
                continue
            best = (1e-6, -1, 0)
            for k in range(x.shape[1]):
                left_g = np.cumsum(np.bincount(x[own, k], weights=g[own], minlength=self.bins + 1))[:-1]
                left_h = np.cumsum(np.bincount(x[own, k], weights=h[own], minlength=self.bins + 1))[:-1]
                right_g, right_h = sum_g - left_g, sum_h - left_h
                gain = left_g**2 / (left_h + self.penalty) + right_g**2 / (right_h + self.penalty) - sum_g**2 / (sum_h + self.penalty)
                gain[(left_h < self.least) | (right_h < self.least)] = 0
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (float(gain[at]), k, at)
            if best[1] >= 0:
                feature[node], cut[node] = best[1], best[2]
                place[own] = 2 * node + 1 + (x[own, best[1]] > best[2])
        return feature, cut, value

    def _values(self, tree, binned: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(binned), dtype=np.int64)
        for _ in range(self.depth):
            f = feature[node]
            inner = f >= 0
            step = 2 * node + 1 + (binned[np.arange(len(node)), np.maximum(f, 0)] > cut[node])
            node = np.where(inner, step, node)
        return value[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        binned = self._binned(x)
        raw = np.full(len(x), self.base)
        for tree in self.nodes:
            raw += self._values(tree, binned)
        return 1 / (1 + np.exp(-raw))


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending scores and calibrated probabilities, by pooling adjacent violators."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []
    for s, y in zip(scores[order], labels[order].astype(float)):
        blocks.append([s, y, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            top = blocks.pop()
            blocks[-1] = [top[0], blocks[-1][1] + top[1], blocks[-1][2] + top[2]]
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])
