"""The nearest of many points in a plane, exactly and without all pairs. numpy only."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Pairs that are held at once.
PAIRS = 1_000_000


def _expanded(counts: np.ndarray, lows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of all ranges (low, count), one after the other."""
    row = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    return row, np.arange(len(row)) - np.repeat(ends - counts, counts) + np.repeat(lows, counts)


def nearest(points: np.ndarray, asked: np.ndarray, reach: np.ndarray | None = None, fits: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index of the point, distance) for every row of ``asked`` (m x 2): the nearest of ``points`` (n x 2), the first one on ties, -1 and infinity where none is.

    ``reach`` is the most distance by row; ``fits`` tells of rows and points which
    pairs may be. All numbers are finite. Grids of squares, each with sides twice as
    long as the one before, are searched for what lies within a side's length, until
    the nearest so far cannot be passed by what was not looked at.
    """
    best, far = np.full(len(asked), -1), np.full(len(asked), np.inf)
    if not len(points) or not len(asked):
        return best, far
    low = points.min(axis=0)
    span = points.max(axis=0) - low
    side = max(float(np.sqrt(span[0] * span[1] / len(points))), float(span.max()) / len(points), 1e-9 * float(np.abs(points).max()), 1e-300) / 2
    # no point is farther than this
    whole = np.hypot(*np.maximum(np.abs(asked - low), np.abs(asked - low - span)).T) * (1 + 1e-9)
    most = whole if reach is None else np.minimum(whole, reach)
    left = np.arange(len(asked))
    while len(left):
        cells = np.floor((points - low) / side).astype(np.int64)
        width = int(cells[:, 0].max()) + 3
        key = (cells[:, 1] + 1) * width + cells[:, 0] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.floor(np.clip((asked[left] - low) / side, -4, np.array([width + 4, int(cells[:, 1].max()) + 4]))).astype(np.int64)
        first, last = np.clip(at[:, 0], 0, width - 2), np.clip(at[:, 0] + 2, 0, width - 1)
        inside = (at[:, 0] >= -1) & (at[:, 0] <= width - 2)
        lows, counts = np.empty((len(left), 3), dtype=np.int64), np.empty((len(left), 3), dtype=np.int64)
        for k in range(3):
            row = (at[:, 1] + k) * width
            lows[:, k] = np.searchsorted(key, row + first)
            counts[:, k] = np.where(inside, np.maximum(np.searchsorted(key, row + last, "right") - lows[:, k], 0), 0)
        done = np.cumsum(counts.sum(axis=1))
        begin = 0
        while begin < len(left):
            end = max(begin + 1, int(np.searchsorted(done, (done[begin - 1] if begin else 0) + PAIRS, "right")))
            i, place = _expanded(counts[begin:end].ravel(), lows[begin:end].ravel())
            if len(i):
                i, j = left[begin + i // 3], order[place]
                dx, dy = points[j, 0] - asked[i, 0], points[j, 1] - asked[i, 1]
                d = np.sqrt(dx * dx + dy * dy)
                ok = d <= (side if reach is None else np.minimum(side, reach[i]))
                if fits is not None:
                    ok[ok] = fits(i[ok], j[ok])
                i, j, d = i[ok], j[ok], d[ok]
                if len(i):
                    new = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                    least = np.minimum.reduceat(d, new)
                    tied = d == np.repeat(least, np.diff(np.r_[new, len(i)]))
                    best[i[new]] = np.minimum.reduceat(np.where(tied, j, len(points)), new)
                    far[i[new]] = least
            begin = end
        # a place on a square's edge may be rounded into the next one: what was found a little within the side is sure
        sure = (far[left] <= side * (1 - 1e-9)) | (most[left] < side * (1 - 1e-9))
        best[left[~sure]], far[left[~sure]] = -1, np.inf
        left = left[~sure]
        side *= 2
    return best, far
