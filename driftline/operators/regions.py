"""Measurement of labelled regions given as pixel rows (image, frame, label, y, x[, value]); 0 is background."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def region_metrics(pixels: DataFrame) -> DataFrame:
    """Area, box, centre, axes, eccentricity, orientation, diameter and intensity of every region: sums over its pixels, in one aggregation.

    Axes are those of the ellipse of equal second moments, each pixel counting as a
    unit square. Orientation is the major axis's angle from the rows.
    """
    c = F.col
    s = pixels.where("label > 0").groupBy("frame", "label").agg(
        F.count("*").alias("area_px"), F.min("x").alias("min_x"), F.min("y").alias("min_y"), (F.max("x") + 1).alias("max_x"), (F.max("y") + 1).alias("max_y"),
        F.avg("x").alias("x"), F.avg("y").alias("y"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("vxy"), F.avg("value").alias("mean_intensity"), F.median("value").alias("median_intensity"),
    )
    vx, vy = c("vx") + 1 / 12, c("vy") + 1 / 12
    spread = F.sqrt((vx - vy) * (vx - vy) + 4 * c("vxy") * c("vxy"))
    big, small = (vx + vy + spread) / 2, (vx + vy - spread) / 2
    return s.withColumns({
        "major_axis_px": 4 * F.sqrt(big), "minor_axis_px": 4 * F.sqrt(F.greatest(small, F.lit(0.0))), "eccentricity": F.sqrt(1 - F.greatest(small, F.lit(0.0)) / big),
        "orientation_rad": 0.5 * F.atan2(2 * c("vxy"), vy - vx), "equivalent_diameter_px": F.sqrt(4 * c("area_px") / F.pi()), "extent_px": F.greatest(c("max_x") - c("min_x"), c("max_y") - c("min_y")),
        "extent_fraction": c("area_px") / ((c("max_x") - c("min_x")) * (c("max_y") - c("min_y"))),
    }).drop("vx", "vy", "vxy")


def keep_instances(regions: DataFrame, least_extent: int = 20, least_area: float | None = None, drop_border: bool = False) -> DataFrame:
    """``regions`` that are large enough, with new_label 1, 2, ... in the order of their old labels per frame."""
    ok = F.col("extent_px") >= least_extent
    if least_area is not None:
        ok = ok & (F.col("area_px") >= least_area)
    if drop_border:
        ok = ok & ~F.col("touches_border")
    return regions.where(ok).withColumn("new_label", F.row_number().over(Window.partitionBy("frame").orderBy("label")))


def filter_diagnostics(regions: DataFrame, least_extent: int = 20) -> DataFrame:
    """Per frame: raw, kept and removed instances, and the removed ones' largest extent and area."""
    out = F.col("extent_px") < least_extent
    return regions.groupBy("frame").agg(F.count("*").alias("raw"), F.count_if(~out).alias("kept"), F.count_if(out).alias("removed"), F.max(F.when(out, F.col("extent_px"))).alias("removed_max_extent_px"), F.max(F.when(out, F.col("area_px"))).alias("removed_max_area_px"))


def border_distance(min_x: Column, min_y: Column, max_x: Column, max_y: Column, width: int, height: int) -> Column:
    """Distance of a box from the image's edge, in pixels."""
    return F.least(min_x, min_y, F.lit(width) - max_x, F.lit(height) - max_y)


def pixel_history(pixels: DataFrame) -> DataFrame:
    """Per pixel over time: median, robust sigma, share of frames with a label, and the largest change between frames."""
    w = Window.partitionBy("y", "x").orderBy("frame")
    rows = pixels.withColumn("change", F.abs(F.col("value") - F.lag("value").over(w)))
    mid = rows.groupBy("y", "x").agg(F.median("value").alias("median"), F.avg((F.col("label") > 0).cast("double")).alias("persistence"), F.max("change").alias("max_change"))
    spread = rows.join(mid.select("y", "x", "median"), ["y", "x"]).groupBy("y", "x").agg((1.4826 * F.median(F.abs(F.col("value") - F.col("median")))).alias("sigma"))
    return mid.join(spread, ["y", "x"])


def principal_axes(voxels: DataFrame, z_scale: float = 1.0) -> DataFrame:
    """Full lengths of the three principal axes of voxel regions (frame, label, z, y, x), longest first, by the roots of the covariance's cubic."""
    z = F.col("z") * z_scale
    s = voxels.where("label > 0").groupBy("frame", "label").agg(F.count("*").alias("n"), F.var_pop("x").alias("a"), F.var_pop("y").alias("b"), F.var_pop(z).alias("c"), F.covar_pop("x", "y").alias("d"), F.covar_pop("x", z).alias("e"), F.covar_pop("y", z).alias("f"))
    c = F.col
    mean = (c("a") + c("b") + c("c")) / 3
    p = F.sqrt(((c("a") - mean) * (c("a") - mean) + (c("b") - mean) * (c("b") - mean) + (c("c") - mean) * (c("c") - mean) + 2 * (c("d") * c("d") + c("e") * c("e") + c("f") * c("f"))) / 6)
    a, b, g = (c("a") - mean) / F.nullif(p, F.lit(0.0)), (c("b") - mean) / F.nullif(p, F.lit(0.0)), (c("c") - mean) / F.nullif(p, F.lit(0.0))
    d, e, f = c("d") / F.nullif(p, F.lit(0.0)), c("e") / F.nullif(p, F.lit(0.0)), c("f") / F.nullif(p, F.lit(0.0))
    det = a * (b * g - f * f) - d * (d * g - f * e) + e * (d * f - b * e)
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / 2))) / 3
    one, three = mean + 2 * p * F.cos(phi), mean + 2 * p * F.cos(phi + 2 * F.pi() / 3)
    ev = [F.coalesce(one, mean), F.coalesce(3 * mean - one - three, mean), F.coalesce(three, mean)]
    return s.select("frame", "label", c("n").alias("volume_vox"), *[F.sqrt(20 * F.greatest(v, F.lit(0.0))).alias(f"principal_axis_{i + 1}") for i, v in enumerate(ev)])
