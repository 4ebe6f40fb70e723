"""Gradient-boosted regression trees on logistic loss, in numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Depth-limited trees over binned features; ``predict`` gives log odds."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, reg: float = 1.0,
                 min_rows: int = 5):
        self.n_trees, self.depth, self.rate, self.reg, self.min_rows = trees, depth, rate, reg, min_rows
        self.cuts: list[np.ndarray] = []
        self.base = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        self.cuts = [np.unique(np.quantile(col, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for col in x.T]
        b = self._bin(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        f = np.full(len(y), self.base)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(b, y - p, p * (1 - p))
            self.trees.append(tree)
            f += self.rate * self._leaf(tree, b)
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        """A complete binary tree in arrays: feature (-1: leaf), cut bin, value."""
        size = (1 << (self.depth + 1)) - 1
        feat, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
        node = np.zeros(len(g), np.int64)
        for at in range(size):
            rows = np.nonzero(node == at)[0]
            if len(rows) == 0:
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            value[at] = gs / (hs + self.reg)
            if 2 * at + 2 >= size or len(rows) < 2 * self.min_rows:
                continue
            best = (1e-6, -1, 0)
            for j in range(b.shape[1]):
                col = b[rows, j]
                gl = np.cumsum(np.bincount(col, g[rows], BINS))[:-1]
                hl = np.cumsum(np.bincount(col, h[rows], BINS))[:-1]
                nl = np.cumsum(np.bincount(col, minlength=BINS))[:-1]
                gain = (gl ** 2 / (hl + self.reg) + (gs - gl) ** 2 / (hs - hl + self.reg)
                        - gs ** 2 / (hs + self.reg))
                gain[(nl < self.min_rows) | (len(rows) - nl < self.min_rows)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
            if best[1] >= 0:
                feat[at], cut[at] = best[1], best[2]
                node[rows] = np.where(b[rows, best[1]] <= best[2], 2 * at + 1, 2 * at + 2)
        return feat, cut, value

    def _leaf(self, tree, b: np.ndarray) -> np.ndarray:
        feat, cut, value = tree
        node = np.zeros(len(b), np.int64)
        for _ in range(self.depth):
            j = feat[node]
            inner = j >= 0
            left = b[np.arange(len(b)), np.maximum(j, 0)] <= cut[node]
            node = np.where(inner, 2 * node + np.where(left, 1, 2), node)
        return value[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        if len(x) == 0:
            return np.zeros(0)
        b = self._bin(x)
        return self.base + self.rate * sum((self._leaf(t, b) for t in self.trees), np.zeros(len(x)))
