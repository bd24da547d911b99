"""Lanes from an image stack: bright walls found in the median image, fitted by a robust line, spaced on a lattice."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .imaging import image


@dataclass(frozen=True)
class LaneSettings:
    """What counts as a wall: sigmas above the profile's own noise, least distance between walls, bands that a trace is taken in, share of bands that must hold it."""

    sigmas: float = 4.0
    separation_px: float = 12.0
    bands: int = 16
    least_support: float = 0.6
    reach_px: float = 6.0


def ridge_peaks(profile: np.ndarray, sigmas: float, separation: float) -> list[int]:
    """Local maxima that stand out of the profile, highest first, each kept if it is ``separation`` from all kept before."""
    smooth = np.convolve(np.pad(profile, 2, mode="edge"), np.ones(5) / 5, "valid")
    mid = np.median(smooth)
    noise = 1.4826 * np.median(np.abs(smooth - mid)) + 1e-9
    tops = [i for i in range(1, len(smooth) - 1) if smooth[i] >= smooth[i - 1] and smooth[i] > smooth[i + 1] and smooth[i] - mid > sigmas * noise]
    kept: list[int] = []
    for i in sorted(tops, key=lambda i: (-smooth[i], i)):
        if all(abs(i - k) >= separation for k in kept):
            kept.append(i)
    return sorted(kept)


def median_line(t: np.ndarray, v: np.ndarray) -> tuple[float, float]:
    """(slope, offset) by the median of all pairs' slopes: a third of the points may be wrong."""
    i, j = np.triu_indices(len(t), 1)
    slope = float(np.median((v[j] - v[i]) / (t[j] - t[i]))) if len(i) else 0.0
    return slope, float(np.median(v - slope * t))


def detect(stack: np.ndarray, s: LaneSettings = LaneSettings()) -> list[tuple[int, float, float, float, float, float, float]]:
    """Lanes of a stack (time, y, x) whose walls run down the image: (index, x and y of origin, unit direction x and y, half width, support).

    Walls are traced band by band from the profile's peaks; a wall needs ``least_support``
    of the bands. A lane lies between two neighbouring walls. Fewer than two walls: none.
    """
    mid = np.median(stack, axis=0)
    height, width = mid.shape
    edges = np.linspace(0, height, s.bands + 1).astype(int)
    walls = []
    for p in ridge_peaks(mid.mean(axis=0), s.sigmas, s.separation_px):
        ys, xs, at = [], [], float(p)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b <= a:
                continue
            lo, hi = max(0, int(at - s.reach_px)), min(width, int(at + s.reach_px) + 1)
            part = mid[a:b, lo:hi].mean(axis=0)
            if part.max() - np.median(mid[a:b]) > 0:
                w = np.clip(part - np.median(part), 0, None)
                if w.sum() > 0:
                    xs.append(lo + float((w * np.arange(len(w))).sum() / w.sum()))
                    ys.append((a + b - 1) / 2)
        if len(ys) >= s.least_support * s.bands and len(ys) > 1:
            slope, offset = median_line(np.array(ys), np.array(xs))
            walls.append((offset, slope, len(ys) / s.bands))
    walls.sort()
    lanes = []
    for k, ((x0, m0, s0), (x1, m1, s1)) in enumerate(zip(walls, walls[1:], strict=False)):
        slope = (m0 + m1) / 2
        length = float(np.hypot(1.0, slope))
        lanes.append((k, (x0 + x1) / 2, 0.0, slope / length, 1 / length, (x1 - x0) / 2 / length, min(s0, s1)))
    return lanes


def detect_lanes(frames: DataFrame, settings: LaneSettings = LaneSettings()) -> DataFrame:
    """Lanes of every movie from its frames (movie, frame, height, width, pixels), as rows that ``lanes.lane_of`` takes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        stack = np.stack([image(r.pixels, r.height, r.width) for r in pdf.itertuples(index=False)])
        return pd.DataFrame([(pdf["movie"].iloc[0], *lane) for lane in detect(stack, settings)], columns=["movie", "lane", "x0", "y0", "dx", "dy", "half_width", "support"])

    return frames.groupBy("movie").applyInPandas(run, "movie bigint, lane int, x0 double, y0 double, dx double, dy double, half_width double, support double")
