"""Histogram gradient-boosted trees for two classes, kept as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """All nodes of all trees side by side; a leaf is its own left and right child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row of ``x``: every row walks all trees at once."""
        total = np.full(len(x), self.base)
        if not len(self.roots) or not len(x):
            return total
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return total + self.value[node].sum(axis=1)

    def score(self, x: np.ndarray, block: int = 4096) -> np.ndarray:
        margin = np.concatenate([self.margin(x[i : i + block]) for i in range(0, max(len(x), 1), block)])
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 64,
    least_rows: int | None = None,
    penalty: float = 1.0,
) -> Forest:
    """Boost ``trees`` level-wise trees on the logistic loss over binned features.

    A leaf has at least ``least_rows`` rows, by default 2 to 10 with the number of rows.
    With no rows, or rows of one class, the forest has no trees and gives the
    smoothed share of class 1.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    none = np.zeros(0, int)
    if len(y) == 0 or y.min() == y.max():
        return Forest(none, np.zeros(0), none, none, np.zeros(0), none, depth, base)
    n, width = x.shape
    least_rows = least_rows or int(np.clip(n // 50, 2, 10))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
    offsets = np.arange(width) * bins
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    margin = np.full(n, base)

    def add_node() -> int:
        k = len(feature)
        feature.append(0), threshold.append(0.0), left.append(k), right.append(k), value.append(0.0)
        return k

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = y - p, p * (1 - p)
        roots.append(add_node())
        open_nodes, leaf = [roots[-1]], np.full(n, roots[-1])
        for level in range(depth + 1):
            slot = np.full(len(feature), -1)
            slot[open_nodes] = np.arange(len(open_nodes))
            rows = np.flatnonzero(slot[leaf] >= 0)
            at = slot[leaf[rows]]
            g = np.bincount(at, gradient[rows], len(open_nodes))
            h = np.bincount(at, hessian[rows], len(open_nodes))
            for k, node in enumerate(open_nodes):
                value[node] = rate * g[k] / (h[k] + penalty)
            if level == depth:
                break
            cells = (at[:, None] * (width * bins) + offsets + binned[rows]).ravel()
            gl, hl, nl = (
                np.bincount(cells, np.repeat(w, width), len(open_nodes) * width * bins)
                .reshape(len(open_nodes), width, bins)
                .cumsum(axis=2)
                for w in (gradient[rows], hessian[rows], np.ones(len(rows)))
            )
            gr, hr, nr = (s[:, :, -1:] - s for s in (gl, hl, nl))
            gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - (g**2 / (h + penalty))[:, None, None]
            gain[(nl < least_rows) | (nr < least_rows)] = -1
            best = gain.reshape(len(open_nodes), -1).argmax(axis=1)
            children = []
            for k, node in enumerate(open_nodes):
                f, b = int(best[k]) // bins, int(best[k]) % bins
                if gain[k, f, b] <= 1e-9 or b >= len(edges[f]):
                    continue
                feature[node], threshold[node] = f, float(edges[f][b])
                left[node], right[node] = add_node(), add_node()
                own = rows[at == k]
                leaf[own] = np.where(binned[own, f] <= b, left[node], right[node])
                children += [left[node], right[node]]
            open_nodes = children
            if not open_nodes:
                break
        margin += np.asarray(value)[leaf]
    as_int = lambda v: np.asarray(v, int)
    return Forest(
        as_int(feature), np.asarray(threshold), as_int(left), as_int(right), np.asarray(value), as_int(roots), depth, base
    )
