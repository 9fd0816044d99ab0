"""Small gradient-boosted trees on binned features: logistic loss, fixed depth, arrays only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees: feature and threshold of each inner node, value of each leaf."""

    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray
    start: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        depth = self.features.shape[1].bit_length()
        rows = np.arange(len(x))
        for f, c, v in zip(self.features, self.cuts, self.leaves, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            z += v[at - len(f)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Each level splits all its nodes at once by the best gain over all features and bins.

    Features of one cut (most are marks of 0 or 1) are summed for all nodes by one matrix product.
    """
    grids = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(g, x[:, j], side="left") for j, g in enumerate(grids)], axis=1)
    width = bins
    many = [j for j, g in enumerate(grids) if len(g) > 1]
    marks = np.array([j for j, g in enumerate(grids) if len(g) == 1], dtype=np.int64)
    low = (binned[:, marks] == 0).astype(np.float64).T
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    start = float(np.log(mean / (1 - mean)))
    z = np.full(len(x), start)
    inner = 2**depth - 1
    all_f, all_c, all_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        f, c = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        at = np.zeros(len(x), dtype=np.int64)
        for level in range(depth):
            nodes, base = 2**level, 2**level - 1
            slot = at - base
            best = np.full(nodes, 1e-9)
            pick = np.full((nodes, 2), -1, dtype=np.int64)
            whole_g = np.bincount(slot, weights=g, minlength=nodes)
            whole_h = np.bincount(slot, weights=h, minlength=nodes)
            if len(marks):
                at_node = np.zeros((len(x), 2 * nodes))
                at_node[np.arange(len(x)), slot] = g
                at_node[np.arange(len(x)), nodes + slot] = h
                sums = low @ at_node
                lg, lh = sums[:, :nodes], sums[:, nodes:]
                rg, rh = whole_g - lg, whole_h - lh
                gain = lg**2 / (lh + l2) + rg**2 / (rh + l2) - whole_g**2 / (whole_h + l2)
                gain[(lh < least / 4) | (rh < least / 4)] = 0
                k = gain.argmax(axis=0)
                top = gain[k, np.arange(nodes)]
                better = top > best
                best[better] = top[better]
                pick[better, 0], pick[better, 1] = marks[k[better]], 0
            for j in many:
                key = slot * width + binned[:, j]
                lg = np.cumsum(np.bincount(key, weights=g, minlength=nodes * width).reshape(nodes, width), axis=1)
                lh = np.cumsum(np.bincount(key, weights=h, minlength=nodes * width).reshape(nodes, width), axis=1)
                rg, rh = whole_g[:, None] - lg, whole_h[:, None] - lh
                gain = lg**2 / (lh + l2) + rg**2 / (rh + l2) - (whole_g**2 / (whole_h + l2))[:, None]
                gain[(lh < least / 4) | (rh < least / 4)] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(nodes), k]
                better = top > best
                best[better] = top[better]
                pick[better, 0], pick[better, 1] = j, k[better]
            for s in range(nodes):
                j, k = pick[s]
                if j >= 0 and k < len(grids[j]):
                    f[base + s], c[base + s] = j, grids[j][k]
            at = 2 * at + 1 + (x[np.arange(len(x)), f[at]] > c[at])
        leaf = at - inner
        v = -rate * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + l2)
        z += v[leaf]
        all_f.append(f), all_c.append(c), all_v.append(v)
    return Trees(np.array(all_f), np.array(all_c), np.array(all_v), start)
