"""Gradient boosting of small trees for a bounded number of rows, with logistic loss."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Trees(NamedTuple):
    """Complete trees of one depth. A row goes right where its feature is over the threshold."""

    feature: np.ndarray  # trees x (2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2**depth
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        depth = self.leaf.shape[1].bit_length() - 1
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - (len(leaf) - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -35, 35)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> Trees:
    """Features are cut into at most 32 parts once; a node's splits come from sums over the parts."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) if len(np.unique(c)) > 32 else np.unique(c)[:-1] for c in x.T]
    width = max(len(e) for e in cuts) + 1
    edge = np.full((len(cuts), width), np.inf)
    for f, e in enumerate(cuts):
        edge[f, : len(e)] = e
    place = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(cuts, x.T, strict=True)], axis=1)
    flat = place + np.arange(len(cuts)) * width
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    margin, parts = np.full(len(y), start), []

    def sums(rows: np.ndarray, of: np.ndarray) -> np.ndarray:
        got = np.bincount(flat[rows].ravel(), np.repeat(of[rows], len(cuts)), len(cuts) * width)
        return np.cumsum(got.reshape(len(cuts), width), axis=1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        at = np.zeros(len(y), dtype=np.int64)
        for node in range(2**depth - 1):
            mine = np.flatnonzero(at == node)
            cut = width
            if len(mine):
                left_g, left_h = sums(mine, g), sums(mine, h)
                all_g, all_h = left_g[0, -1], left_h[0, -1]
                gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
                gain[np.isinf(edge)] = -np.inf
                best = int(gain.argmax())
                if gain.flat[best] > 1e-9:
                    feature[node], cut = divmod(best, width)
                    threshold[node] = edge[feature[node], cut]
            at[mine] = 2 * node + 1 + (place[mine, feature[node]] > cut)
        at -= 2**depth - 1
        leaf = -rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + ridge)
        margin += leaf[at]
        parts.append((feature, threshold, leaf))
    return Trees(*(np.array(c) for c in zip(*parts, strict=True)), start)
