"""What a body's outline gained and lost between two observations, and the map of a device that stands still."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .imaging import image


def surface_delta(pixels: DataFrame, step: int = 1) -> DataFrame:
    """Pixels that a tracked body (track_id, frame, y, x) gained and lost from ``frame`` to ``frame + step``, by place against the centre's move.

    Sets are compared by a full join on the pixel; a pixel lies at the front or rear
    if its way from the old centre along the move exceeds that across it, else on
    the flank. Without a move all is flank. Rows: track_id, frame, n_kept, and
    extension_ and retraction_ front, rear, flank. Bodies seen at both frames only.
    """
    centre = pixels.groupBy("track_id", "frame").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    after = centre.select("track_id", (F.col("frame") - step).alias("frame"), F.col("cx").alias("nx"), F.col("cy").alias("ny"))
    moves = centre.join(after, ["track_id", "frame"]).withColumns({"mx": F.col("nx") - F.col("cx"), "my": F.col("ny") - F.col("cy")})
    old = pixels.select("track_id", "frame", "y", "x", F.lit(True).alias("old"))
    new = pixels.select("track_id", (F.col("frame") - step).alias("frame"), "y", "x", F.lit(True).alias("new"))
    both = old.join(new, ["track_id", "frame", "y", "x"], "full").join(moves, ["track_id", "frame"])
    px, py = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    # both sides times the move's length: no root, and nothing is divided by zero
    along, across = px * F.col("mx") + py * F.col("my"), F.abs(px * F.col("my") - py * F.col("mx"))
    place = F.when(along > across, "front").when(-along > across, "rear").otherwise("flank")
    gained, lost = F.col("old").isNull(), F.col("new").isNull()
    counts = [F.count_if(c & (place == p)).alias(f"{name}_{p}") for name, c in (("extension", gained), ("retraction", lost)) for p in ("front", "rear", "flank")]
    return both.groupBy("track_id", "frame").agg(F.count_if(~gained & ~lost).alias("n_kept"), *counts)


@dataclass(frozen=True)
class AtlasSettings:
    """Bounds of the device map. The defaults are part of the results."""

    change_sigmas: float = 3.0
    least_persistence: float = 0.9
    longest_cell_px: float = 260.0
    largest_cell_px: float = 3200.0
    bright_sigmas: float = 3.0
    least_wall_elongation: float = 4.0
    outside_percentile: float = 2.0


#: The classes in the order of their codes.
CLASSES = ("STATIC_BACKGROUND", "CHANNEL_WALL", "OUTSIDE_DEVICE", "ARTIFACT", "VALID_CELL_REGION", "UNKNOWN")


def patches(mask: np.ndarray) -> np.ndarray:
    """Patches of a mask joined by sides or corners: the same positive number all over a patch, 0 outside."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        least = np.where(mask, label, mask.size + 1)
        wide = np.pad(least, 1, constant_values=mask.size + 1)
        h, w = mask.shape
        near = np.min([wide[i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=0)
        # a pixel's label is a place: follow it once, so long patches settle in few rounds
        at = np.where(mask, near, 0)
        jumped = np.where(mask, at.ravel()[np.maximum(at, 1) - 1], 0)
        if (jumped == label).all():
            return label
        label = jumped


def device_map(stack: np.ndarray, occupied: np.ndarray | None = None, s: AtlasSettings = AtlasSettings()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class codes, background, persistence) of a registered stack (time, y, x).

    What hardly changes is static; static patches larger than any cell are device,
    flat ones background (outside, if as dark as the darkest and touching the
    edge), bright ones walls if elongated and else artifacts. All else can hold a
    cell, and so can a pixel where a track was seen.
    """
    background = np.median(stack, axis=0)
    off = np.abs(stack - background)
    noise = np.median(off, axis=0)
    change = off / (1.4826 * np.maximum(noise, np.median(noise)) + 1e-6)
    persistence = (change < s.change_sigmas).mean(axis=0)
    static = persistence >= s.least_persistence
    if occupied is not None:
        static &= ~occupied
    level = np.median(background)
    bright = background - level > s.bright_sigmas * (1.4826 * np.median(np.abs(background - level)) + 1e-6)

    def large(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pixels of patches larger than a cell, and of the elongated ones among them."""
        label = patches(mask)
        big, long = np.zeros(mask.shape, bool), np.zeros(mask.shape, bool)
        y, x = np.nonzero(label)
        if len(y):
            _, k = np.unique(label[y, x], return_inverse=True)
            n = np.bincount(k)
            span = np.zeros(len(n))
            for v in (y, x):
                lo, hi = np.full(len(n), v.max() + 1), np.full(len(n), -1)
                np.minimum.at(lo, k, v)
                np.maximum.at(hi, k, v)
                span = np.maximum(span, hi - lo + 1)
            ok = (span > s.longest_cell_px) | (n > s.largest_cell_px)
            big[y, x], long[y, x] = ok[k], (ok & (span * span / n >= s.least_wall_elongation))[k]
        return big, long

    flat, _ = large(static & ~bright)
    lit, walls = large(static & bright)
    dark = patches(background <= np.percentile(background, s.outside_percentile))
    edge = set(np.concatenate([dark[0], dark[-1], dark[:, 0], dark[:, -1]]).tolist()) - {0}
    code = np.full(background.shape, CLASSES.index("VALID_CELL_REGION"), np.int8)
    code[flat] = CLASSES.index("STATIC_BACKGROUND")
    code[flat & np.isin(dark, list(edge))] = CLASSES.index("OUTSIDE_DEVICE")
    code[lit] = CLASSES.index("ARTIFACT")
    code[walls] = CLASSES.index("CHANNEL_WALL")
    return code, background, persistence


def device_maps(frames: DataFrame, settings: AtlasSettings = AtlasSettings()) -> DataFrame:
    """One map per movie from its frames (movie, frame, height, width, pixels): movie, height, width, classes (one byte a pixel), background."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        stack = np.stack([image(r.pixels, r.height, r.width) for r in pdf.itertuples(index=False)])
        code, background, _ = device_map(stack, None, settings)
        return pd.DataFrame({"movie": [pdf["movie"].iloc[0]], "height": [code.shape[0]], "width": [code.shape[1]], "classes": [code.tobytes()], "background": [background.astype(np.float32).tobytes()]})

    return frames.groupBy("movie").applyInPandas(run, "movie bigint, height int, width int, classes binary, background binary")
