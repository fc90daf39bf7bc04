"""Gradient-boosted trees for small training sets: logistic loss, binned features, Platt-calibrated scores.

Rows: equal rows count as often as they are given; without rows of both classes all scores tend to the one class; ties
of a split go to the first feature and bin.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 16


def held_out(n: int) -> np.ndarray:
    """Every fourth pair of rows (examples alternate between the classes)."""
    return np.arange(n) // 2 % 4 == 3


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Boosted:
    """An ensemble of trees of depth two and the line that calibrates its margins."""

    trees: list[tuple] = field(default_factory=list)
    bias: float = 0.0
    rate: float = 0.3
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for (f, cut), left, right in self.trees:
            goes = x[:, f] > cut
            for side, (g, c, low, high) in ((~goes, left), (goes, right)):
                out[side] += self.rate * np.where(x[side, g] > c, high, low)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.margin(x) + self.shift)

    @staticmethod
    def _split(bins: np.ndarray, g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[float, int, int]:
        """Gain, feature and bin of the best split of the rows."""
        best = (0.0, 0, BINS)
        total_g, total_h = g.sum(), h.sum()
        for f in range(bins.shape[1]):
            left_g = np.cumsum(np.bincount(bins[:, f], g, BINS + 1))
            left_h = np.cumsum(np.bincount(bins[:, f], h, BINS + 1))
            gain = left_g**2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge) - total_g**2 / (total_h + ridge)
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), f, k)
        return best

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 40) -> Boosted:
        """Fit on three quarters of the rows, calibrate on the rest."""
        held = held_out(len(x))
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
        cut = lambda f, k: float(cuts[f][k]) if k < len(cuts[f]) else float("inf")
        model = cls()
        train = ~held
        p = float(np.clip(y[train].mean(), 1e-3, 1 - 1e-3))
        model.bias = float(np.log(p / (1 - p)))
        margin = np.full(len(x), model.bias)
        for _ in range(rounds):
            q = sigmoid(margin)
            g, h = y - q, np.maximum(q * (1 - q), 1e-6)
            _, f, k = cls._split(bins[train], g[train], h[train])
            sides = []
            for side in (bins[:, f] <= k, bins[:, f] > k):
                rows = side & train
                _, f2, k2 = cls._split(bins[rows], g[rows], h[rows]) if rows.any() else (0.0, 0, BINS)
                values = []
                for leaf in (rows & (bins[:, f2] <= k2), rows & (bins[:, f2] > k2)):
                    values.append(float(g[leaf].sum() / (h[leaf].sum() + 1.0)))
                sides.append((f2, cut(f2, k2), *values))
            model.trees.append(((f, cut(f, k)), *sides))
            margin = model.margin(x)
        model._calibrate(margin[held], y[held])
        return model

    def _calibrate(self, margin: np.ndarray, y: np.ndarray) -> None:
        """Platt's line by Newton steps, with his smoothed targets."""
        n1, n0 = y.sum(), len(y) - y.sum()
        target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        w = np.array([1.0, 0.0])
        design = np.stack([margin, np.ones(len(margin))], 1)
        for _ in range(30):
            p = sigmoid(design @ w)
            hessian = design.T @ (design * np.maximum(p * (1 - p), 1e-6)[:, None]) + 1e-1 * np.eye(2)
            w = w - np.linalg.solve(hessian, design.T @ (p - target) + 1e-1 * (w - [1.0, 0.0]))
        self.slope, self.shift = map(float, w)

    def cutoff(self, x: np.ndarray, y: np.ndarray, precision: float, weight: np.ndarray) -> float:
        """The threshold at which the rows above it, by weight, still reach `precision` and every one that is lower adds
        wrong rows alone: halfway between the last right row above it and the next row. Above 1 if there is none."""
        p = self.probability(x)
        order = np.argsort(-p, kind="stable")
        reached = np.cumsum((y * weight)[order]) / np.cumsum(weight[order])
        good = np.flatnonzero((reached >= precision) & (y[order] > 0))
        if not len(good):
            return 1.1
        last = good[-1]
        lower = p[order][last + 1 :]
        lower = lower[lower < p[order[last]]]
        return float((p[order[last]] + (lower[0] if len(lower) else 0.0)) / 2)
