"""Robust location and spread, per group and exact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the median absolute deviation of a normal distribution is its sigma over this.
MAD_SIGMA = 1.4826


def outliers(rows: DataFrame, by: str, value: str, k: float = 3.0) -> DataFrame:
    """``rows`` further than ``k`` robust sigmas from their group's median, with median and sigma. Two aggregations: the median, then that of the distances."""
    mid = rows.groupBy(by).agg(F.median(value).alias("median"))
    spread = rows.join(mid, by).groupBy(by).agg(F.first("median").alias("median"), (MAD_SIGMA * F.median(F.abs(F.col(value) - F.col("median")))).alias("sigma"))
    return rows.join(spread, by).where((F.col("sigma") > 0) & (F.abs(F.col(value) - F.col("median")) > k * F.col("sigma")))
