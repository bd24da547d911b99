"""Shape and texture of objects from their pixels (frame, label, y, x, value): aggregates and equi-joins where they suffice, numpy by object where not."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The floor of invariants before the logarithm; grey levels of a texture; side of a standard crop and the length of the major axis in it.
HU_FLOOR, GREY_LEVELS, CROP_SIDE, CROP_MAJOR = 1e-12, 16, 64, 48.0
OBJECT = ("frame", "label")


def moments(pixels: DataFrame) -> DataFrame:
    """Central moments of order 2 and 3 of every object, scaled so that size does not count: n20, n11, n02, n30, n21, n12, n03.

    Sums of powers about the object's corner are whole numbers, so one aggregation
    of the pixels is exact whatever their order.
    """
    corner = pixels.groupBy(*OBJECT).agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    u, v = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    at = pixels.join(corner, list(OBJECT)).select(*OBJECT, u.cast("bigint").alias("u"), v.cast("bigint").alias("v"))

    def power(p: int, q: int) -> Column:
        out = F.lit(1).cast("bigint")
        for name, k in (("u", p), ("v", q)):
            for _ in range(k):
                out = out * F.col(name)
        return out

    orders = [(p, q) for p in range(4) for q in range(4) if p + q <= 3]
    sums = at.groupBy(*OBJECT).agg(*[F.sum(power(p, q)).cast("double").alias(f"s{p}{q}") for p, q in orders])
    cx, cy = F.col("s10") / F.col("s00"), F.col("s01") / F.col("s00")

    def central(p: int, q: int) -> Column:
        total = F.lit(0.0)
        for i in range(p + 1):
            for j in range(q + 1):
                total = total + math.comb(p, i) * math.comb(q, j) * F.pow(-cx, F.lit(float(p - i))) * F.pow(-cy, F.lit(float(q - j))) * F.col(f"s{i}{j}")
        return total / F.pow("s00", F.lit(1 + (p + q) / 2))

    return sums.select(*OBJECT, F.col("s00").cast("bigint").alias("area_px"), *[central(p, q).alias(f"n{p}{q}") for p, q in ((2, 0), (1, 1), (0, 2), (3, 0), (2, 1), (1, 2), (0, 3))])


def hu_invariants(pixels: DataFrame) -> DataFrame:
    """The seven invariants of every object under moves, turns and sizes: hu1 to hu7, as signed logarithms of magnitudes no less than HU_FLOOR."""
    n20, n11, n02, n30, n21, n12, n03 = (F.col(c) for c in ("n20", "n11", "n02", "n30", "n21", "n12", "n03"))
    a, b, c, d = n30 + n12, n21 + n03, n30 - 3 * n12, 3 * n21 - n03
    spread = n20 - n02
    values = [
        n20 + n02,
        spread * spread + 4 * n11 * n11,
        c * c + d * d,
        a * a + b * b,
        c * a * (a * a - 3 * b * b) + d * b * (3 * a * a - b * b),
        spread * (a * a - b * b) + 4 * n11 * a * b,
        d * a * (a * a - 3 * b * b) - c * b * (3 * a * a - b * b),
    ]
    logs = [F.when(v <= -HU_FLOOR, 1.0).otherwise(-1.0) * F.log10(F.greatest(F.abs(v), F.lit(HU_FLOOR))) for v in values]
    return moments(pixels).select(*OBJECT, *[x.alias(f"hu{i}") for i, x in enumerate(logs, 1)])


def outline(pixels: DataFrame) -> DataFrame:
    """Free sides of every object's pixels (the length of its outline along the grid) and pixels with one: frame, label, sides, edge_pixels.

    A side is free where the neighbour belongs to another object or to none; pixels
    meet their neighbours by equality.
    """
    own = pixels.select(*OBJECT, "y", "x")
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1))])
    asked = own.withColumn("s", F.explode(steps)).select(*OBJECT, "y", "x", (F.col("y") + F.col("s.dy")).alias("ny"), (F.col("x") + F.col("s.dx")).alias("nx"))
    there = own.select(*OBJECT, F.col("y").alias("ny"), F.col("x").alias("nx"))
    free = asked.join(there, [*OBJECT, "ny", "nx"], "left_anti").groupBy(*OBJECT, "y", "x").agg(F.count("*").alias("n"))
    return free.groupBy(*OBJECT).agg(F.sum("n").alias("sides"), F.count("*").alias("edge_pixels"))


def texture(pixels: DataFrame, levels: int = GREY_LEVELS) -> DataFrame:
    """Co-occurrence of grey levels of neighbouring pixels of one object, as the mean over four directions: glcm_contrast, glcm_homogeneity, glcm_energy, glcm_correlation.

    Levels are equal steps between an object's 1st and 99th percentile; one level
    where these are equal. A pair counts both ways. Objects of one pixel have none.
    Both joins sort: small as pixels are when packed, as a broadcast they fill the driver.
    """
    ends = pixels.groupBy(*OBJECT).agg(F.percentile("value", F.lit(0.01)).alias("lo"), F.percentile("value", F.lit(0.99)).alias("hi"))
    # to nine places: the last bits of a percentile must not decide
    step = F.floor(F.round((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * levels, 9))
    level = F.when(F.col("hi") > F.col("lo"), F.greatest(F.lit(0), F.least(F.lit(levels - 1), step))).otherwise(0).cast("int")
    own = pixels.join(ends.hint("merge"), list(OBJECT)).select(*OBJECT, "y", "x", level.alias("g"))
    steps = F.array(*[F.struct(F.lit(k).alias("way"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for k, (dy, dx) in enumerate(((0, 1), (1, 0), (1, 1), (1, -1)))])
    one = own.withColumn("s", F.explode(steps)).select(*OBJECT, "s.way", F.col("g").alias("a"), (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    met = one.join(own.hint("merge"), [*OBJECT, "y", "x"]).groupBy(*OBJECT, "way", F.col("a"), F.col("g").alias("b")).agg(F.count("*").alias("n"))
    both = met.unionByName(met.select(*OBJECT, "way", F.col("b").alias("a"), F.col("a").alias("b"), "n")).groupBy(*OBJECT, "way", "a", "b").agg(F.sum("n").cast("double").alias("n"))
    n, a, b = F.col("n"), F.col("a"), F.col("b")
    sums = both.groupBy(*OBJECT, "way").agg(
        F.sum("n").alias("t"), F.sum(n * (a - b) * (a - b)).alias("c"), F.sum(n / (1 + (a - b) * (a - b))).alias("h"), F.sum(n * n).alias("e"),
        F.sum(n * a).alias("sa"), F.sum(n * a * a).alias("saa"), F.sum(n * a * b).alias("sab"),
    )
    t = F.col("t")
    mean = F.col("sa") / t
    variance, covariance = F.col("saa") / t - mean * mean, F.col("sab") / t - mean * mean
    ways = sums.select(*OBJECT, (F.col("c") / t).alias("contrast"), (F.col("h") / t).alias("homogeneity"), (F.sqrt("e") / t).alias("energy"), F.when(variance > 1e-12, covariance / variance).otherwise(1.0).alias("correlation"))
    return ways.groupBy(*OBJECT).agg(*[F.avg(c).alias(f"glcm_{c}") for c in ("contrast", "homogeneity", "energy", "correlation")])


def _cross(o: np.ndarray, p: np.ndarray, q: np.ndarray) -> float:
    return float((p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0]))


def hull_area(points: np.ndarray) -> float:
    """Area of the convex hull of points (n x 2): from the two extreme ones, the farthest point on either side is taken in until none is left (quickhull)."""
    points = np.unique(points, axis=0).astype(float)
    if len(points) < 3:
        return 0.0

    def beyond(a: np.ndarray, b: np.ndarray, some: np.ndarray) -> float:
        far = (b[0] - a[0]) * (some[:, 1] - a[1]) - (b[1] - a[1]) * (some[:, 0] - a[0])
        some, far = some[far > 1e-9], far[far > 1e-9]
        if not len(some):
            return 0.0
        c = some[int(far.argmax())]
        return abs(_cross(a, b, c)) / 2 + beyond(a, c, some) + beyond(c, b, some)

    first, last = points[0], points[-1]
    return beyond(first, last, points) + beyond(last, first, points)


def hulls(pixels: DataFrame) -> DataFrame:
    """Area of the convex hull of every object's pixels, corners and all, and solidity, its pixels' part of that. Only a row's ends can be on the hull, so no more than two pixels a row reach a worker."""
    rows = pixels.groupBy(*OBJECT, "y").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, ends = pdf["y"].to_numpy(dtype=float), [(pdf["lo"].to_numpy(dtype=float) - 0.5), (pdf["hi"].to_numpy(dtype=float) + 0.5)]
        corners = np.concatenate([np.stack([x, y + d], axis=1) for x in ends for d in (-0.5, 0.5)])
        area, pixels_ = hull_area(corners), int(pdf["n"].sum())
        return pd.DataFrame({"frame": pdf["frame"].iloc[:1], "label": pdf["label"].iloc[:1], "hull_area_px": [area], "solidity": [pixels_ / area]})

    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema}
    return rows.groupBy(*OBJECT).applyInPandas(run, f"frame {kinds['frame']}, label {kinds['label']}, hull_area_px double, solidity double")


def standard_crop(y: np.ndarray, x: np.ndarray, side: int = CROP_SIDE, major: float = CROP_MAJOR) -> np.ndarray:
    """A mask in a frame of its own: centred, the major axis upright and ``major`` pixels long, and turned over so that the third moments of both axes are not negative."""
    at = np.stack([y, x]).astype(float)
    centre = at.mean(axis=1, keepdims=True)
    off = at - centre
    size, axes = np.linalg.eigh(off @ off.T / off.shape[1])
    scale = major / max(4 * math.sqrt(max(size[1], 0.0)), 1e-6)
    grid = (np.mgrid[0:side, 0:side].reshape(2, -1) - (side - 1) / 2) / scale
    place = centre + axes[:, 1:2] * grid[0] + axes[:, 0:1] * grid[1]
    low = at.min(axis=1).astype(int) - 1
    mask = np.zeros((at.max(axis=1).astype(int) - low + 2).tolist())
    mask[y.astype(int) - low[0], x.astype(int) - low[1]] = 1
    # the four pixels around each place, by how near they are; nothing lies outside
    place = place - low[:, None]
    corner = np.floor(place).astype(int)
    part = place - corner
    value = np.zeros(place.shape[1])
    for dy in (0, 1):
        for dx in (0, 1):
            r, c = corner[0] + dy, corner[1] + dx
            inside = (r >= 0) & (c >= 0) & (r < mask.shape[0]) & (c < mask.shape[1])
            near = (part[0] if dy else 1 - part[0]) * (part[1] if dx else 1 - part[1])
            value[inside] += near[inside] * mask[r[inside], c[inside]]
    out = (value >= 0.5).reshape(side, side)
    for axis in (0, 1):
        where = np.nonzero(out)[axis]
        if len(where) and ((where - where.mean()) ** 3).mean() < 0:
            out = np.flip(out, axis)
    return out


def crops(pixels: DataFrame, side: int = CROP_SIDE) -> DataFrame:
    """Standard crops of all objects: frame, label, crop (side x side bits, row by row)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.packbits(standard_crop(pdf["y"].to_numpy(), pdf["x"].to_numpy(), side))
        return pd.DataFrame({"frame": pdf["frame"].iloc[:1], "label": pdf["label"].iloc[:1], "crop": [bits.tobytes()]})

    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema}
    return pixels.select(*OBJECT, "y", "x").groupBy(*OBJECT).applyInPandas(run, f"frame {kinds['frame']}, label {kinds['label']}, crop binary")
