"""Images as rows (movie, frame, height, width, pixels): registration, display range, masks. One row is one frame; numpy works inside it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def image(pixels: bytes, height: int, width: int) -> np.ndarray:
    return np.frombuffer(pixels, np.float32).reshape(height, width)


def shift_between(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """(dx, dy, peak) that carries ``a`` onto ``b``: windowed phase correlation with a parabola through the peak."""
    h, w = a.shape
    window = np.outer(np.hanning(h), np.hanning(w))
    fa, fb = (np.fft.rfft2((x - x.mean()) * window) for x in (a, b))
    cross = fb * np.conj(fa)
    cross /= np.maximum(np.abs(cross), 1e-12)
    c = np.fft.irfft2(cross, s=(h, w))
    y, x = np.unravel_index(int(c.argmax()), c.shape)

    def finer(lo: float, mid: float, hi: float) -> float:
        bend = lo - 2 * mid + hi
        return 0.5 * (lo - hi) / bend if abs(bend) > 1e-12 else 0.0

    dy = y + finer(c[y - 1, x], c[y, x], c[(y + 1) % h, x])
    dx = x + finer(c[y, x - 1], c[y, x], c[y, (x + 1) % w])
    return float(dx - w if dx > w / 2 else dx), float(dy - h if dy > h / 2 else dy), float(c[y, x])


def register(frames: DataFrame) -> DataFrame:
    """Every frame's shift against its movie's first: movie, frame, dx, dy, peak.

    The first frame joins every other, so frames are correlated one by one wherever
    they lie; a movie of any length is no single task.
    """
    ref = frames.groupBy("movie").agg(F.min_by(F.struct("pixels", "height", "width"), "frame").alias("ref"))

    def run(batches):
        for pdf in batches:
            got = [shift_between(image(r["pixels"], r["height"], r["width"]), image(p, h, w)) for r, p, h, w in zip(pdf["ref"], pdf["pixels"], pdf["height"], pdf["width"], strict=True)]
            yield pd.DataFrame({"movie": pdf["movie"], "frame": pdf["frame"], "dx": [g[0] for g in got], "dy": [g[1] for g in got], "peak": [g[2] for g in got]})

    return frames.join(ref, "movie").mapInPandas(run, "movie bigint, frame int, dx double, dy double, peak double")


def forward_backward(frames: DataFrame) -> DataFrame:
    """How far the shift from each frame to its movie's next one and the shift back miss each other: movie, frame, next_frame, dx, dy, error_px.

    Frames meet their successor by equality of places, so any frame's pair is a task's
    row; a consistent motion has an error near 0.
    """
    from pyspark.sql import Window

    after = frames.select("movie", "frame").withColumn("next_frame", F.lead("frame").over(Window.partitionBy("movie").orderBy("frame"))).where("next_frame is not null")
    side = frames.select("movie", F.col("frame").alias("next_frame"), F.col("pixels").alias("next_pixels"))
    both = frames.select("movie", "frame", "height", "width", "pixels").join(after, ["movie", "frame"]).join(side, ["movie", "next_frame"])

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                a, b = image(r.pixels, r.height, r.width), image(r.next_pixels, r.height, r.width)
                (fx, fy, _), (bx, by, _) = shift_between(a, b), shift_between(b, a)
                rows.append((r.movie, r.frame, r.next_frame, (fx - bx) / 2, (fy - by) / 2, float(np.hypot(fx + bx, fy + by))))
            yield pd.DataFrame(rows, columns=["movie", "frame", "next_frame", "dx", "dy", "error_px"])

    return both.mapInPandas(run, "movie bigint, frame int, next_frame int, dx double, dy double, error_px double")


def stretch(values: np.ndarray) -> np.ndarray:
    """An image for display: the 0.5 to 99.5 percentile to 0 to 255."""
    lo, hi = np.percentile(values, [0.5, 99.5])
    return np.clip((values - lo) / max(hi - lo, 1e-12) * 255, 0, 255).astype(np.uint8)


def shifted_iou(a: np.ndarray, a_at: tuple[int, int], b: np.ndarray, b_at: tuple[int, int], shift: tuple[float, float] = (0.0, 0.0)) -> float:
    """Overlap of two masks given by crops and their places (row, column), the first moved by ``shift`` rounded to pixels."""
    r0, c0 = a_at[0] + round(shift[0]), a_at[1] + round(shift[1])
    lo_r, lo_c = max(r0, b_at[0]), max(c0, b_at[1])
    hi_r, hi_c = min(r0 + a.shape[0], b_at[0] + b.shape[0]), min(c0 + a.shape[1], b_at[1] + b.shape[1])
    both = 0
    if hi_r > lo_r and hi_c > lo_c:
        both = int(np.logical_and(a[lo_r - r0 : hi_r - r0, lo_c - c0 : hi_c - c0], b[lo_r - b_at[0] : hi_r - b_at[0], lo_c - b_at[1] : hi_c - b_at[1]]).sum())
    union = int(a.astype(bool).sum() + b.astype(bool).sum()) - both
    return both / union if union else 0.0


def label_rows(frames: DataFrame) -> DataFrame:
    """Label images (movie, frame, height, width, pixels) as rows of their pixels: movie, frame, label, y, x; background is left out."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                m = image(r.pixels, r.height, r.width)
                y, x = np.nonzero(m)
                yield pd.DataFrame({"movie": r.movie, "frame": r.frame, "label": m[y, x].astype(int), "y": y, "x": x})

    return frames.mapInPandas(run, "movie bigint, frame int, label int, y int, x int")
