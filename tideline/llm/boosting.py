"""Gradient-boosted trees for small labelled samples, in numpy: histogram splits, logistic loss, Platt calibration.

The sample is bounded (see the callers), so fitting runs in one process; scoring takes whole batches at once.
"""

from __future__ import annotations

import numpy as np


def _bins(x: np.ndarray, most: int = 48) -> list[np.ndarray]:
    out = []
    for j in range(x.shape[1]):
        u = np.unique(x[:, j])
        if len(u) > most:
            u = np.unique(np.quantile(x[:, j], np.linspace(0, 1, most)))
        out.append((u[1:] + u[:-1]) / 2)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Trees:
    """Complete binary trees of one depth; node k has children 2k+1 and 2k+2."""

    def __init__(self, depth: int = 3, rounds: int = 40, rate: float = 0.3, l2: float = 1.0) -> None:
        self.depth, self.rounds, self.rate, self.l2 = depth, rounds, rate, l2
        self.base, self.scale, self.shift, self.threshold = 0.0, 1.0, 0.0, 0.5
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        n, inner = len(y), 2**self.depth - 1
        p = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        edges = _bins(x)
        codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1) if n else np.zeros((0, x.shape[1]), int)
        wide = max((len(e) for e in edges), default=0) + 1
        z = np.full(n, self.base)
        for _ in range(self.rounds):
            q = _sigmoid(z)
            g, h = y - q, q * (1 - q)
            feat, cut, leaf = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(2**self.depth)
            node = np.zeros(n, int)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                local = node - first
                best = np.full(width, 1e-6)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    k = local * wide + codes[:, j]
                    gs = np.bincount(k, g, width * wide).reshape(width, wide).cumsum(1)
                    hs = np.bincount(k, h, width * wide).reshape(width, wide).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                    c = gain[:, : len(e)].argmax(1)
                    better = gain[np.arange(width), c] > best
                    best = np.where(better, gain[np.arange(width), c], best)
                    feat[first : first + width][better] = j
                    cut[first : first + width][better] = e[c[better]]
                node = 2 * node + 1 + (x[np.arange(n), feat[node]] > cut[node])
            at = node - inner
            leaf = self.rate * np.bincount(at, g, 2**self.depth) / (np.bincount(at, h, 2**self.depth) + self.l2)
            z = z + leaf[at]
            self.trees.append((feat, cut, leaf))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        z, rows, inner = np.full(len(x), self.base), np.arange(len(x)), 2**self.depth - 1
        for feat, cut, leaf in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feat[node]] > cut[node])
            z += leaf[node - inner]
        return z

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        """Platt scaling on held-out rows, then the threshold with the best F1 on them (0.5 if they have one class only)."""
        if len(y) < 20 or y.min() == y.max():
            return self
        m = self.margin(x)
        t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        # A prior of (1, 0) keeps the scale finite where the sample is separable.
        a, b = 1.0, 0.0
        for _ in range(30):
            p = _sigmoid(a * m + b)
            w = np.maximum(p * (1 - p), 1e-6)
            hess = np.array([[(w * m * m).sum() + 5.0, (w * m).sum()], [(w * m).sum(), w.sum() + 5.0]])
            step = np.linalg.solve(hess, [((t - p) * m).sum() - 5.0 * (a - 1), (t - p).sum() - 5.0 * b])
            step *= min(1.0, 0.5 / max(1e-9, np.abs(step).max()))
            a, b = a + step[0], b + step[1]
            if np.abs(step).max() < 1e-6:
                break
        self.scale, self.shift = float(max(a, 0.1)), float(b)
        p = self.probability(x)
        best = -1.0
        for c in np.arange(0.1, 0.95, 0.05):
            on = p >= c
            f1 = 2 * (on & (y > 0)).sum() / max(1, on.sum() + (y > 0).sum())
            if f1 > best + 1e-9 or (f1 > best - 1e-9 and abs(c - 0.5) < abs(self.threshold - 0.5)):
                best, self.threshold = max(best, f1), float(c)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * self.margin(x) + self.shift)
