"""Gradient-boosted trees for a bounded training set, compiled to Spark expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Boosted:
    """Sum of trees (nested (feature, threshold, left, right) or leaf values), then a calibrated logistic."""

    names: list[str]
    base: float = 0.0
    trees: list = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def raw(self, x: np.ndarray) -> np.ndarray:
        def walk(tree, rows: np.ndarray, out: np.ndarray) -> None:
            if not isinstance(tree, tuple):
                out[rows] += tree
                return
            left = x[rows, tree[0]] <= tree[1]
            walk(tree[2], rows[left], out)
            walk(tree[3], rows[~left], out)

        out = np.full(len(x), self.base)
        for t in self.trees:
            walk(t, np.arange(len(x)), out)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))

    def column(self, features: dict[str, Column]) -> Column:
        """The calibrated probability as a native expression of the features."""

        def build(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            return F.when(features[self.names[tree[0]]] <= F.lit(float(tree[1])), build(tree[2])).otherwise(build(tree[3]))

        raw = F.lit(float(self.base))
        for t in self.trees:
            raw = raw + build(t)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(self.slope) * raw + F.lit(self.shift))))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, rate: float):
    leaf = float(-rate * g[rows].sum() / (h[rows].sum() + 1.0))
    if depth == 0 or len(rows) < 20:
        return leaf
    whole = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
    best = (1e-3, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[rows, f])
        for cut in (values[:-1] + values[1:])[:: max(1, len(values) // 32)] / 2:
            left = x[rows, f] <= cut
            gl, hl = g[rows][left].sum(), h[rows][left].sum()
            gr, hr = g[rows].sum() - gl, h[rows].sum() - hl
            gain = gl * gl / (hl + 1) + gr * gr / (hr + 1) - whole
            if gain > best[0]:
                best = (gain, f, float(cut))
    if best[1] is None:
        return leaf
    left = x[rows, best[1]] <= best[2]
    return (best[1], best[2], _grow(x, g, h, rows[left], depth - 1, rate), _grow(x, g, h, rows[~left], depth - 1, rate))


def fit(names: list[str], x: np.ndarray, y: np.ndarray, rounds: int = 12, depth: int = 3, rate: float = 0.5, precision: float = 0.98) -> Boosted:
    """Trees on two thirds of the rows; slope, shift and threshold on the other third.

    The threshold is the least probability above which the calibration rows reach ``precision``.
    """
    part = np.arange(len(x)) % 3 == 2
    fx, fy = x[~part], y[~part]
    p0 = np.clip(fy.mean(), 0.01, 0.99)
    model = Boosted(names, float(np.log(p0 / (1 - p0))))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-model.raw(fx)))
        model.trees.append(_grow(fx, p - fy, p * (1 - p), np.arange(len(fx)), depth, rate))
    z, cy = model.raw(x[part]), y[part]
    a, b = 1.0, 0.0
    # Platt's targets keep the slope finite where the classes part
    n1, n0 = cy.sum(), len(cy) - cy.sum()
    t = np.where(cy == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(500):
        p = 1 / (1 + np.exp(-(a * z + b)))
        a -= 0.05 * ((p - t) * z).mean()
        b -= 0.05 * (p - t).mean()
    model.slope, model.shift = float(a), float(b)
    p = model.probability(x[part])
    good = [c for c in np.unique(np.round(p, 6)) if cy[p >= c].mean() >= precision]
    model.threshold = float(min(good)) - 1e-6 if good else 1.0
    return model
