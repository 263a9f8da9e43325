"""Gradient-boosted trees for a yes/no label, with monotonic constraints.

Fitted with numpy on a bounded table; a fitted model is five flat node arrays plus the root of
every tree, so that scoring is a few array look-ups per level for a whole batch of rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Node k tests ``x[feature[k]] <= threshold[k]`` and goes to left[k], else to right[k];
    a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                goes_left = x[rows, self.feature[at]] <= self.threshold[at]
                at = np.where(goes_left, self.left[at], self.right[at])
            total += self.value[at]
        return total

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -40, 40)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    distinct = np.unique(column)
    if len(distinct) > bins:
        distinct = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))
        return distinct
    return (distinct[1:] + distinct[:-1]) / 2


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: np.ndarray,
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 64,
    ridge: float = 5.0,
    least: float = 1.0,
) -> Forest:
    """``monotone[f]`` is +1 (probability may only rise with feature f), -1 (only fall) or 0.

    A split that breaks the order of its children's values is refused, and the children keep to
    their side of the middle between them, all the way down; so the whole tree, and the sum of
    all trees, is monotonic."""
    rows, width = x.shape
    edges = [_edges(x[:, f], bins) for f in range(width)]
    binned = [np.searchsorted(edges[f], x[:, f], "left") for f in range(width)]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if rows else 0.5
    start = float(np.log(share / (1 - share)))
    margin = np.full(rows, start)
    nodes: list[list[float]] = []
    roots = []

    def leaf(value: float) -> int:
        k = len(nodes)
        nodes.append([0, np.inf, k, k, value])
        return k

    def grow(members: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = gradient[members], hessian[members]
        total_g, total_h = g.sum(), h.sum()
        own = float(np.clip(total_g / (total_h + ridge), low, high))
        best = (1e-6, None)
        if level < depth and len(members) > 1:
            for f in range(width):
                count = len(edges[f])
                if not count:
                    continue
                b = binned[f][members]
                left_g = np.cumsum(np.bincount(b, g, count + 1))[:-1]
                left_h = np.cumsum(np.bincount(b, h, count + 1))[:-1]
                right_g, right_h = total_g - left_g, total_h - left_h
                left_v = np.clip(left_g / (left_h + ridge), low, high)
                right_v = np.clip(right_g / (right_h + ridge), low, high)
                gain = (
                    left_v * left_g - 0.5 * left_v**2 * (left_h + ridge)
                    + right_v * right_g - 0.5 * right_v**2 * (right_h + ridge)
                    - own * total_g + 0.5 * own**2 * (total_h + ridge)
                )
                gain[(left_h < least) | (right_h < least)] = -1
                gain[monotone[f] * (right_v - left_v) < 0] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], f, k, float(left_v[k]), float(right_v[k]))
        if best[1] is None:
            return leaf(rate * own)
        _, f, k, left_v, right_v = best
        goes_left = binned[f][members] <= k
        middle = (left_v + right_v) / 2
        sides = [(low, high), (low, high)]
        if monotone[f] > 0:
            sides = [(low, middle), (middle, high)]
        elif monotone[f] < 0:
            sides = [(middle, high), (low, middle)]
        here = len(nodes)
        nodes.append([f, edges[f][k], 0, 0, 0])
        nodes[here][2] = grow(members[goes_left], level + 1, *sides[0])
        nodes[here][3] = grow(members[~goes_left], level + 1, *sides[1])
        return here

    everyone = np.arange(rows)
    for _ in range(trees if rows and 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = y - p, p * (1 - p)
        before = len(nodes)
        roots.append(grow(everyone, 0, -4.0, 4.0))
        one = _flat(nodes, roots[-1:], depth, 0.0)
        margin += one.margins(x)
        if len(nodes) == before + 1 and abs(nodes[-1][4]) < 1e-6:
            break
    return _flat(nodes or [[0, np.inf, 0, 0, 0.0]], roots, depth, start)


def _flat(nodes: list, roots: list, depth: int, start: float) -> Forest:
    table = np.array(nodes, np.float64)
    return Forest(
        table[:, 0].astype(np.int32), table[:, 1], table[:, 2].astype(np.int32),
        table[:, 3].astype(np.int32), table[:, 4], np.array(roots, np.int32), depth, start,
    )
