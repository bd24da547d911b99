"""Gradient-boosted trees for a yes/no target: histogram training and flat node arrays, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All trees' nodes in flat arrays; ``root[t]`` is tree t's first node; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds for each row of ``x``: all trees descend together, a level at a time."""
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.root, (len(x), len(self.root))).copy()
        for _ in range(self.depth):
            go = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(go, self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)


def constant(p: float) -> Trees:
    """A model that always answers ``p``."""
    none = np.zeros(0, dtype=np.int32)
    return Trees(none, np.zeros(0), none, none, np.zeros(0), none, float(np.log(p / (1 - p))), 0)


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least_rows: int = 8, least_gain: float = 1e-3) -> Trees:
    """Boost ``rounds`` trees on the logistic loss.

    ``monotone`` has +1, -1 or 0 per feature: a split on a constrained feature must
    order its children's values, and their midpoint bounds all values below it, so
    the whole model is monotonic. Rows with missing values are not expected. With
    one class only the model is constant.
    """
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
    if len(y) < 2 * least_rows or y.min() == y.max():
        return constant(share if len(y) else 0.5)
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    code = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(d)], axis=1)
    width = max(len(c) for c in cuts) + 1
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def new_node() -> int:
        k = len(feature)
        feature.append(0), threshold.append(0.0), left.append(k), right.append(k), value.append(0.0)
        return k

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        roots.append(new_node())
        level = [(roots[-1], np.arange(n), -np.inf, np.inf)]
        for at in range(depth + 1):
            below = []
            for k, rows, low, high in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                value[k] = float(np.clip(gs / (hs + ridge), low, high)) * rate
                margin_leaf = True
                if at < depth and len(rows) >= 2 * least_rows:
                    best = _split(code[rows], g[rows], h[rows], width, ridge, least_rows, monotone, low, high, gs, hs)
                    if best and best[0] > least_gain:
                        _, j, b, lv, rv = best
                        if b < len(cuts[j]):
                            mid = (lv + rv) / 2
                            go = code[rows, j] <= b
                            feature[k], threshold[k] = j, float(cuts[j][b])
                            left[k], right[k] = new_node(), new_node()
                            bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[int(monotone[j])]
                            below += [(left[k], rows[go], *bounds[0]), (right[k], rows[~go], *bounds[1])]
                            margin_leaf = False
                if margin_leaf:
                    margin[rows] += value[k]
            level = below
    leaf = np.arange(len(feature)) == np.array(left)
    return Trees(np.array(feature, dtype=np.int32), np.array(threshold), np.array(left, dtype=np.int32), np.array(right, dtype=np.int32), np.where(leaf, value, 0.0), np.array(roots, dtype=np.int32), base, depth)


def _split(code, g, h, width, ridge, least_rows, monotone, low, high, gs, hs):
    """The best allowed split of a node: (gain, feature, bin, left value, right value), or None."""
    d = code.shape[1]
    flat = (code + np.arange(d) * width).ravel()
    gl = np.bincount(flat, np.repeat(g, d), d * width).reshape(d, width).cumsum(axis=1)
    hl = np.bincount(flat, np.repeat(h, d), d * width).reshape(d, width).cumsum(axis=1)
    nl = np.bincount(flat, minlength=d * width).reshape(d, width).cumsum(axis=1)
    lv, rv = np.clip(gl / (hl + ridge), low, high), np.clip((gs - gl) / (hs - hl + ridge), low, high)
    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
    allowed = (nl >= least_rows) & (len(code) - nl >= least_rows) & ((rv - lv) * monotone[:, None] >= 0)
    gain = np.where(allowed, gain, -np.inf)
    k = int(gain.argmax())
    j, b = divmod(k, width)
    return (float(gain[j, b]), j, b, float(lv[j, b]), float(rv[j, b])) if np.isfinite(gain[j, b]) else None
