"""Rows of the first schema to the second, on read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unrotate(along: Column, across: Column, ux: Column, uy: Column) -> tuple[Column, Column]:
    """dx, dy of a jump given along and across an axis of unit direction (ux, uy); null if any part is."""
    return along * ux - across * uy, along * uy + across * ux


def upgrade_unlinked(rows: DataFrame, ux: float | None = None, uy: float | None = None) -> DataFrame:
    """Unlinked starts of either schema with the second one's columns: dx_px and dy_px are kept where they are there, else turned back from along and across."""
    out = rows
    if "dx_px" not in rows.columns:
        dx, dy = unrotate(F.col("along_channel_px"), F.col("across_channel_px"), F.lit(ux).cast("double"), F.lit(uy).cast("double"))
        out = out.withColumns({"dx_px": dx, "dy_px": dy}).drop("along_channel_px", "across_channel_px")
    for c in ("dz_px", "mahalanobis", "would_have_cost_chi2"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
    return out.withColumn("implied_speed_um_per_hr", F.col("implied_speed_um_per_min") * 60.0)


def upgrade_tracks(rows: DataFrame) -> DataFrame:
    """Track rows of the first schema: steps and confidence under their new names, velocities along an axis dropped (they are derived anew)."""
    names = {"step_px": "distance_from_previous_px", "step_um": "distance_from_previous_um", "detection_confidence": "segmentation_confidence"}
    out = rows.drop("v_along_um_per_min", "v_across_um_per_min")
    for old, new in names.items():
        if old in out.columns and new not in out.columns:
            out = out.withColumnRenamed(old, new)
    return out
