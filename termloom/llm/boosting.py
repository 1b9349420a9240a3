"""Gradient boosted trees for weighted examples, and the Spark expression of a fitted model."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BINS = 32


@dataclass
class Node:
    feature: int = -1
    cut: float = 0.0
    value: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def apply(self, x: np.ndarray) -> np.ndarray:
        if self.low is None:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.cut, self.low.apply(x), self.high.apply(x))

    def column(self, features: list[Column]) -> Column:
        if self.low is None:
            return F.lit(float(self.value))
        return F.when(
            features[self.feature] <= F.lit(float(self.cut)), self.low.column(features)
        ).otherwise(self.high.column(features))


@dataclass
class Boosted:
    """Sum of trees on the scale of log odds."""

    start: float
    trees: list[Node] = field(default_factory=list)

    def odds(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for tree in self.trees:
            total += tree.apply(x)
        return total

    def column(self, features: list[Column]) -> Column:
        """Probability as nested CASE expressions."""
        total = F.lit(self.start)
        for tree in self.trees:
            total = total + tree.column(features)
        return 1 / (1 + F.exp(-total))


def boost(
    x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3,
    least: int = 5, ridge: float = 1.0, weight: np.ndarray | None = None, cuts: list[np.ndarray] | None = None,
) -> Boosted:
    """Newton boosting of the logistic loss; cuts are given, or taken from quantiles of each feature.

    A row of weight n counts as n equal rows.
    """
    weight = np.ones(len(y)) if weight is None else weight.astype(float)
    share = np.clip((weight @ y) / weight.sum() if len(y) else 0.5, 0.01, 0.99)
    model = Boosted(float(np.log(share / (1 - share))))
    if len(set(y.tolist())) < 2:
        return model
    if cuts is None:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    # A value is at most cut i if its bin is at most i.
    bins = np.stack([np.searchsorted(own, c) for own, c in zip(cuts, x.T, strict=True)], axis=1)
    odds = np.full(len(y), model.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-odds))
        sums = np.stack([weight, weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)])
        tree = _grow(bins, sums, cuts, np.arange(len(y)), depth, rate, least, ridge)
        model.trees.append(tree)
        odds += tree.apply(x)
    return model


def _grow(bins, sums, cuts, rows, depth, rate, least, ridge) -> Node:
    n, g, h = sums[:, rows].sum(axis=1)
    node = Node(value=float(-rate * g / (h + ridge)))
    if not depth or n < 2 * least:
        return node
    best, at = 1e-6, -1
    for j, own in enumerate(cuts):
        if not len(own):
            continue
        low = [np.cumsum(np.bincount(bins[rows, j], s[rows], len(own) + 1))[:-1] for s in sums]
        m, a, b = low
        gain = a * a / (b + ridge) + (g - a) ** 2 / (h - b + ridge) - g * g / (h + ridge)
        gain[(m < least) | (n - m < least)] = 0
        i = int(np.argmax(gain >= gain.max() * (1 - 1e-9)))
        # Of equally good cuts the first one; their sums differ in the last bits only.
        if gain[i] > best * (1 + 1e-9):
            best, at, node.feature, node.cut = gain[i], i, j, float(own[i])
    if node.feature >= 0:
        low = bins[rows, node.feature] <= at
        node.low = _grow(bins, sums, cuts, rows[low], depth - 1, rate, least, ridge)
        node.high = _grow(bins, sums, cuts, rows[~low], depth - 1, rate, least, ridge)
    return node
