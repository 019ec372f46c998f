"""Gradient-boosted trees for the logistic loss, on binned features, and Platt scaling."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Binary classifier; features are cut into quantile bins, trees grow level by level on gradient histograms."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: float = 3.0, ridge: float = 1.0):
        self.n_trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        y = y.astype(float)
        steps = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(col, steps)) for col in x.T]
        b = self._binned(x)
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(len(x), self.base)
        self.trees = []
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-margin))
            tree, leaf = self._grow(b, p - y, p * (1 - p))
            self.trees.append(tree)
            margin += tree[2][leaf]
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, col, side="left") for c, col in zip(self.cuts, x.T)]).astype(np.int32)

    def _grow(self, b: np.ndarray, grad: np.ndarray, hess: np.ndarray):
        """A full tree of ``depth``: per inner node a feature and a bin (rows above go right); values of the leaves."""
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, np.int32), np.full(inner, np.iinfo(np.int32).max, np.int32)
        node, n_bins = np.zeros(len(b), np.int64), self.bins + 1
        for level in range(self.depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.zeros(width)
            for f in range(b.shape[1]):
                cell = at * n_bins + b[:, f]
                g = np.bincount(cell, grad, width * n_bins).reshape(width, n_bins).cumsum(axis=1)
                h = np.bincount(cell, hess, width * n_bins).reshape(width, n_bins).cumsum(axis=1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + self.ridge) + (gt - g) ** 2 / (ht - h + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(h < self.least / 10) | (ht - h < self.least / 10)] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                won = top > best + 1e-9
                best[won] = top[won]
                feature[first : first + width][won] = f
                cut[first : first + width][won] = k[won]
            node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > cut[node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, 2**self.depth), np.bincount(leaf, hess, 2**self.depth)
        return (feature, cut, -self.rate * g / (h + self.ridge)), leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        rows, out = np.arange(len(b)), np.full(len(b), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(b), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


class Platt:
    """Probability of a margin: a logistic curve, given by slope and offset or fitted by Newton steps on held-out labels."""

    def __init__(self, weights: tuple[float, float] = (0.5, 0.0)):
        self.weights = np.array(weights)

    def fit(self, margin: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 0.01) -> Platt:
        y = y.astype(float)
        hits = y.sum()
        target = np.where(y > 0, (hits + 1) / (hits + 2), 1 / (len(y) - hits + 2))
        w = np.array([0.5, 0.0])
        x = np.column_stack([margin, np.ones(len(margin))])
        prior = np.array([0.5, 0.0])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-x @ w))
            hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
            w = w - np.linalg.solve(hess, x.T @ (p - target) + ridge * (w - prior))
        self.weights = w
        return self

    def chance(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.weights[0] * margin + self.weights[1])))
