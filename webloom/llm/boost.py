"""Gradient-boosted trees with logistic loss, small enough to train on the driver and to score by whole columns."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Complete binary trees of one depth over features cut at quantiles; ``slope`` and ``offset`` are the calibration."""

    rounds: int = 100
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    least: float = 0.5
    start: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """x: rows by features, y: 0 or 1. With one class only, the model is a constant."""
        n, width = x.shape
        rate = (y.sum() + 1) / (n + 2)
        self.start, self.trees = float(np.log(rate / (1 - rate))), []
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        score = np.full(n, self.start)
        for _ in range(self.rounds if 0 < y.sum() < n else 0):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            features, thresholds = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first = 2**level - 1
                for k in range(2**level):
                    rows = np.flatnonzero(node == k)
                    if split := self._split(binned[rows], gradient[rows], weight[rows]):
                        j, b = split
                        features[first + k], thresholds[first + k] = j, cuts[j][b]
                inner = first + node
                node = node * 2 + (x[np.arange(n), features[inner]] > thresholds[inner])
            g = np.bincount(node, gradient, 2**self.depth)
            h = np.bincount(node, weight, 2**self.depth)
            leaves = self.rate * g / (h + 1.0)
            score += leaves[node]
            self.trees.append((features, thresholds, leaves))
        return self

    def _split(self, binned: np.ndarray, gradient: np.ndarray, weight: np.ndarray) -> tuple[int, int] | None:
        best, at = 1e-6, None
        if len(binned) < 2:
            return at
        g, h = gradient.sum(), weight.sum()
        for j in range(binned.shape[1]):
            gl = np.cumsum(np.bincount(binned[:, j], gradient, self.bins))[:-1]
            hl = np.cumsum(np.bincount(binned[:, j], weight, self.bins))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(hl < self.least) | (h - hl < self.least)] = 0
            if gain.max() > best:
                best, at = gain.max(), (j, int(gain.argmax()))
        return at

    def margin(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for features, thresholds, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                inner = 2**level - 1 + node
                node = node * 2 + (x[rows, features[inner]] > thresholds[inner])
            score += leaves[node]
        return score

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 200) -> BoostedTrees:
        """Platt's scaling on a holdout, held near the identity by a small penalty."""
        m = self.margin(x)
        a, b = 1.0, 0.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(a * m + b)))
            w = p * (1 - p)
            ga, gb = ((y - p) * m).sum() - (a - 1), (y - p).sum() - b
            haa, hab, hbb = (w * m * m).sum() + 1, (w * m).sum(), w.sum() + 1
            det = haa * hbb - hab * hab
            da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
            a, b = a + da, b + db
            if abs(da) + abs(db) < 1e-9:
                break
        self.slope, self.offset = float(max(a, 0.05)), float(b)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margin(x) + self.offset)))
