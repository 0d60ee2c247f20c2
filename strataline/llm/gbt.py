"""Gradient-boosted trees for two classes in numpy: histogram splits, complete trees of fixed depth, Platt calibration."""

from __future__ import annotations

import json

import numpy as np


class Gbt:
    """feature[t, i], cut[t, i] of the inner nodes and value[t, j] of the leaves of each tree; p = 1 / (1 + exp(-(a * score + b)))."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, value: np.ndarray, a: float = 1.0, b: float = 0.0) -> None:
        self.feature, self.cut, self.value, self.a, self.b = feature, cut, value, a, b

    @classmethod
    def train(cls, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 5.0, l2: float = 1.0) -> "Gbt":
        n, m = x.shape
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
        binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(m)], 1)  # bin <= i means x <= edges[i]
        inner = 2**depth - 1
        feature, cut, value = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
        score = np.zeros(n)
        for t in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, int)
            for level in range(depth):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-9)
                for f in range(m):
                    k = (node - first) * bins + binned[:, f]
                    gs = np.bincount(k, g, width * bins).reshape(width, bins).cumsum(1)
                    hs = np.bincount(k, h, width * bins).reshape(width, bins).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                    gain[(hs < least) | (ht - hs < least)] = 0
                    gain = gain[:, : len(edges[f])]
                    if not gain.shape[1]:
                        continue
                    at = gain.argmax(1)
                    top = gain[np.arange(width), at]
                    for j in np.nonzero(top > best)[0]:
                        best[j], feature[t, first + j], cut[t, first + j] = top[j], f, edges[f][at[j]]
                node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > cut[t, node])
            leaf = node - inner
            gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
            value[t] = rate * gs / (hs + l2)
            score += value[t, leaf]
        return cls(feature, cut, value)

    def score(self, x: np.ndarray) -> np.ndarray:
        out, rows, inner = np.zeros(len(x)), np.arange(len(x)), self.feature.shape[1]
        for f, c, v in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), int)
            while len(x) and node[0] < inner:  # all rows are at one depth
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.a * self.score(x) + self.b)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 3000) -> None:
        """Platt scaling on a held-out set, with its smoothed targets."""
        s = self.score(x)
        want = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(steps):
            d = 1 / (1 + np.exp(-(a * s + b))) - want
            a -= 0.05 * (d * s).mean() / (1 + (s * s).mean())
            b -= 0.05 * d.mean()
        self.a, self.b = float(a), float(b)

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump({"feature": self.feature.tolist(), "cut": np.where(np.isinf(self.cut), 1e300, self.cut).tolist(), "value": np.round(self.value, 5).tolist(), "a": self.a, "b": self.b}, f, separators=(",", ":"))

    @classmethod
    def load(cls, path: str) -> "Gbt":
        with open(path) as f:
            m = json.load(f)
        return cls(np.array(m["feature"]), np.array(m["cut"]), np.array(m["value"]), m["a"], m["b"])
