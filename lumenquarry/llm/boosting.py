"""Gradient-boosted trees on binned dense features, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class BoostedTrees:
    """Logistic boosting with second-order leaf values; every tree has `depth` full levels."""

    rounds: int = 60
    depth: int = 4
    rate: float = 0.2
    ridge: float = 1.0
    least: float = 4.0
    edges: list = field(default_factory=list)
    trees: list = field(default_factory=list)
    bias: float = 0.0

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        marks = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, k], marks)) if len(x) else np.empty(0) for k in range(x.shape[1])]
        b = self._bins(x)
        rate = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.bias = float(np.log(rate / (1 - rate)))
        margin = np.full(len(y), self.bias)
        for _ in range(self.rounds if len(y) else 0):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            splits = []
            for _level in range(self.depth):
                nodes = 1 << _level
                feature, cut = np.zeros(nodes, np.int64), np.full(nodes, BINS, np.int64)  # all go left
                best = np.full(nodes, 1e-6)
                for k in range(x.shape[1]):
                    key = node * BINS + b[:, k]
                    gs, hs = (np.bincount(key, w, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1) for w in (g, h))
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(hs < self.least * 0.25) | (ht - hs < self.least * 0.25)] = 0
                    at = gain.argmax(axis=1)
                    better = gain[np.arange(nodes), at] > best
                    best[better] = gain[np.arange(nodes), at][better]
                    feature[better], cut[better] = k, at[better]
                splits.append((feature, cut))
                node = node * 2 + (b[np.arange(len(y)), feature[node]] > cut[node])
            gs, hs = (np.bincount(node, w, 1 << self.depth) for w in (g, h))
            leaf = -self.rate * gs / (hs + self.ridge)
            self.trees.append((splits, leaf))
            margin += leaf[node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out = self._bins(x), np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for splits, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in splits:
                node = node * 2 + (b[rows, feature[node]] > cut[node])
            out += leaf[node]
        return out


class Isotonic:
    """Non-decreasing map from margins to probabilities, by pooling neighbours that are out of order."""

    def __init__(self, margin: np.ndarray, y: np.ndarray):
        order = np.argsort(margin, kind="stable")
        blocks: list[list[float]] = []  # sum of labels, rows, first and last margin
        for m, v in zip(margin[order], y[order], strict=True):
            blocks.append([float(v), 1.0, m, m])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
        self.at = np.array([x for b in blocks for x in (b[2], b[3])])
        # half a label of each kind keeps the ends off 0 and 1 in small pools
        self.value = np.array([x for b in blocks for x in [(b[0] + 0.05) / (b[1] + 0.1)] * 2])

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        if not len(self.at):
            return np.clip(1 / (1 + np.exp(-margin)), 0, 1)
        return np.clip(np.interp(margin, self.at, self.value), 0, 1)
