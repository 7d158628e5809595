"""Gradient-boosted trees: fitted on a bounded table, applied as a column expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    feature: int
    at_most: float
    left: Split | Leaf
    right: Split | Leaf


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: float, ridge: float) -> Split | Leaf:
    best = (1e-6, None, None)
    whole = g.sum() ** 2 / (h.sum() + ridge)
    if depth and h.sum() >= 2 * least:
        for k in range(x.shape[1]):
            order = np.argsort(x[:, k], kind="stable")
            v, cg, ch = x[order, k], np.cumsum(g[order]), np.cumsum(h[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            gl, hl = cg[cut], ch[cut]
            gain = gl**2 / (hl + ridge) + (cg[-1] - gl) ** 2 / (ch[-1] - hl + ridge) - whole
            gain[(hl < least) | (ch[-1] - hl < least)] = 0
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), k, float((v[cut[i]] + v[cut[i] + 1]) / 2))
    if best[1] is None:
        return Leaf(float(-g.sum() / (h.sum() + ridge)))
    left = x[:, best[1]] <= best[2]
    return Split(best[1], best[2], _grow(x[left], g[left], h[left], depth - 1, least, ridge),
                 _grow(x[~left], g[~left], h[~left], depth - 1, least, ridge))


def _apply(tree: Split | Leaf, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, Leaf):
        return np.full(len(x), tree.value)
    return np.where(x[:, tree.feature] <= tree.at_most, _apply(tree.left, x), _apply(tree.right, x))


@dataclass(frozen=True)
class Forest:
    """Trees whose values add up to the log odds."""

    trees: tuple[Split | Leaf, ...]
    rate: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.rate * sum(_apply(t, x) for t in self.trees)

    def column(self, features: list[Column]) -> Column:
        """The same score over feature columns."""

        def one(tree: Split | Leaf) -> Column:
            if isinstance(tree, Leaf):
                return F.lit(tree.value)
            return F.when(features[tree.feature] <= F.lit(tree.at_most), one(tree.left)).otherwise(one(tree.right))

        total = F.lit(0.0)
        for tree in self.trees:
            total = total + one(tree)
        return total * self.rate


def boost(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 4, rate: float = 0.4, least: float = 1.0, ridge: float = 1.0) -> Forest:
    """Newton boosting of the logistic loss; ``least`` bounds the hessian in a leaf."""
    score, grown = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, p - y, p * (1 - p), depth, least, ridge)
        grown.append(tree)
        score += rate * _apply(tree, x)
    return Forest(tuple(grown), rate)


def threshold(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest score from which on held-out rows are right at that precision."""
    order = np.argsort(-score, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.r_[score[order][1:] < score[order][:-1], True] if len(y) else np.empty(0, bool)
    ok = np.flatnonzero((right >= precision) & last)
    return float(score[order][ok[-1]]) if len(ok) else float("inf")
