"""Gradient-boosted trees with logistic loss for a few thousand rows."""

from __future__ import annotations

import numpy as np

from .labelled import sigmoid


class BoostedTrees:
    """Complete trees of a fixed depth over binned columns, each fitted to the gradient of the last sum."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.depth = depth
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        code = self._codes(x)
        rows, columns = code.shape
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        total = np.full(rows, self.start)
        self.feature, self.cut, self.leaf = [], [], []
        nodes = 1 << depth
        for _ in range(trees):
            p = sigmoid(total)
            grad, curve = y - p, p * (1 - p)
            at = np.zeros(rows, np.int64)
            feature, cut = np.zeros(nodes, np.int64), np.full(nodes, bins)
            for level in range(depth):
                first, width = (1 << level) - 1, 1 << level
                key = (at[:, None] - first) * (bins + 1) + code + np.arange(columns) * width * (bins + 1)
                size = columns * width * (bins + 1)
                g, h = (np.bincount(key.ravel(), np.repeat(v, columns), size).reshape(columns, width, bins + 1).cumsum(axis=2) for v in (grad, curve))
                gt, ht = g[..., -1:], h[..., -1:]
                gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
                flat = gain.transpose(1, 0, 2).reshape(width, -1)
                best = flat.argmax(axis=1)
                good = flat[np.arange(width), best] > 1e-6
                feature[first : first + width] = np.where(good, best // (bins + 1), 0)
                cut[first : first + width] = np.where(good, best % (bins + 1), bins)
                at = 2 * at + 1 + (code[np.arange(rows), feature[at]] > cut[at])
            leaf = at - (nodes - 1)
            value = rate * np.bincount(leaf, grad, nodes) / (np.bincount(leaf, curve, nodes) + ridge)
            total = total + value[leaf]
            self.feature.append(feature), self.cut.append(cut), self.leaf.append(value)

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, k]) for k, c in enumerate(self.cuts)])

    def margins(self, x: np.ndarray) -> np.ndarray:
        code, rows = self._codes(x), np.arange(len(x))
        total = np.full(len(x), self.start)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (code[rows, feature[at]] > cut[at])
            total += leaf[at - (len(leaf) - 1)]
        return total
