"""Small gradient-boosted trees for a logistic target, trained with numpy.

Made for a few thousand rows of small-integer features, so that a model is
trained in about a second and predicted one row at a time without arrays.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: (feature, cut, left, right) where left is taken if value <= cut; or (-1, value, 0, 0)
Node = tuple[int, float, int, int]
#: Fewer rows than this are walked one by one.
_FEW = 64


@dataclass(frozen=True)
class BoostedTrees:
    base: float
    trees: tuple[tuple[Node, ...], ...]

    def probability(self, row: list[float]) -> float:
        total = self.base
        for tree in self.trees:
            f, cut, left, right = tree[0]
            while f >= 0:
                f, cut, left, right = tree[left if row[f] <= cut else right]
            total += cut
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, total))))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """The same for many rows at once."""
        if len(x) < _FEW:
            return np.array([self.probability(row) for row in x.tolist()])
        total = np.full(len(x), self.base)
        for tree in self.trees:
            total += _values(tree, x)
        return 1.0 / (1.0 + np.exp(-np.clip(total, -50.0, 50.0)))


def _values(tree: tuple[Node, ...], x: np.ndarray) -> np.ndarray:
    """The leaf value of each row."""
    feature, cut, left, right = (np.array(c) for c in zip(*tree, strict=True))
    at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    while len(rows):
        rows = rows[feature[at[rows]] >= 0]
        here = at[rows]
        at[rows] = np.where(x[rows, feature[here]] <= cut[here], left[here], right[here])
    return cut[at]


def _grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, rate: float, least: float, out: list[Node]) -> int:
    place = len(out)
    out.append((-1, rate * float(gradient.sum() / (hessian.sum() + 1.0)), 0, 0))
    if depth == 0:
        return place
    g, h = gradient.sum(), hessian.sum()
    best, gain = None, 1e-6
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        values = x[order, f]
        edges = np.flatnonzero(values[1:] > values[:-1])
        if not len(edges):
            continue
        gl, hl = np.cumsum(gradient[order])[edges], np.cumsum(hessian[order])[edges]
        score = gl**2 / (hl + 1.0) + (g - gl) ** 2 / (h - hl + 1.0) - g**2 / (h + 1.0)
        score[(hl < least) | (h - hl < least)] = 0.0
        k = int(np.argmax(score))
        if score[k] > gain:
            best, gain = (f, float((values[edges[k]] + values[edges[k] + 1]) / 2)), float(score[k])
    if best is None:
        return place
    f, cut = best
    low = x[:, f] <= cut
    left = _grow(x[low], gradient[low], hessian[low], depth - 1, rate, least, out)
    right = _grow(x[~low], gradient[~low], hessian[~low], depth - 1, rate, least, out)
    out[place] = (f, cut, left, right)
    return place


def fit_boosted(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, least: float = 1.0) -> BoostedTrees:
    """Trees fitted by Newton steps on the logistic loss; deterministic."""
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = math.log(share / (1 - share))
    total = np.full(len(y), base)
    trees = []
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-total))
        nodes: list[Node] = []
        _grow(x, y - p, p * (1 - p), depth, rate, least, nodes)
        trees.append(tuple(nodes))
        total += _values(trees[-1], x)
    return BoostedTrees(base, tuple(trees))
