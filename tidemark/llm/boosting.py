"""Gradient-boosted trees for binary targets and isotonic calibration, on small training sets."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Complete binary tree: inner node ``i`` has children ``2i+1`` and ``2i+2``."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[node]] > self.threshold[node])
        return self.value[node - (2**self.depth - 1)]


def _grow(slots: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, ridge: float, bins: list[np.ndarray]) -> Tree:
    """``slots``: for each feature and row the number of cuts below the value."""
    inner = 2**depth - 1
    feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
    node = np.zeros(len(grad), dtype=np.int64)
    for level in range(depth):
        first, n = 2**level - 1, 2**level
        own = node - first
        sums = [np.bincount(own, w, n) for w in (grad, hess)]
        best, after = np.full(n, 1e-6), np.full(n, np.iinfo(np.int64).max)
        enough = np.bincount(own, minlength=n) >= 8
        for f, cuts in enumerate(bins):
            if not len(cuts):
                continue
            key, wide = own * (len(cuts) + 1) + slots[f], n * (len(cuts) + 1)
            left_g, left_h = (np.cumsum(np.bincount(key, w, wide).reshape(n, -1), axis=1)[:, :-1] for w in (grad, hess))
            g, h = (x[:, None] for x in sums)
            gain = left_g**2 / (left_h + ridge) + (g - left_g) ** 2 / (h - left_h + ridge) - g**2 / (h + ridge)
            k = gain.argmax(axis=1)
            better = enough & (gain[np.arange(n), k] > best)
            at = np.flatnonzero(better)
            best[at], after[at] = gain[at, k[at]], k[at]
            feature[first + at], threshold[first + at] = f, cuts[k[at]]
        node = 2 * node + 1 + (slots[feature[node], np.arange(len(node))] > after[own])
    leaf = node - inner
    g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
    return Tree(feature, threshold, g / (h + ridge), depth)


@dataclass
class BoostedTrees:
    base: float
    rate: float
    trees: list[Tree]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> BoostedTrees:
        bins = [u[:-1] + np.diff(u) / 2 if len(u := np.unique(x[:, f])) <= 32 else np.unique(np.quantile(x[:, f], np.linspace(0.03, 0.97, 32))) for f in range(x.shape[1])]
        slots = np.stack([np.searchsorted(cuts, x[:, f], side="left") for f, cuts in enumerate(bins)])
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        model = cls(float(np.log(mean / (1 - mean))), rate, [])
        margin = np.full(len(y), model.base)
        for _ in range(n_trees):
            p = 1 / (1 + np.exp(-margin))
            tree = _grow(slots, y - p, p * (1 - p), depth, ridge, bins)
            model.trees.append(tree)
            margin += rate * tree.predict(x)
        return model

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))


@dataclass
class Isotonic:
    """Monotone map from margin to probability, fitted by pooling adjacent violators."""

    at: np.ndarray
    value: np.ndarray

    @classmethod
    def fit(cls, score: np.ndarray, y: np.ndarray) -> Isotonic:
        """Rows of an equal score are one point; a pooled block has one value from its first to its last score."""
        scores, at = np.unique(score, return_inverse=True)
        blocks: list[list[float]] = []
        for s, total, count in zip(scores.tolist(), np.bincount(at, y).tolist(), np.bincount(at).tolist(), strict=True):
            blocks.append([total, count, s, s])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                total, count, _, last = blocks.pop()
                blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + count, blocks[-1][2], last]
        return cls(np.array([x for b in blocks for x in b[2:]]), np.array([b[0] / b[1] for b in blocks for _ in range(2)]))

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.at, self.value)
