"""Operators over all pairs of a track's observations: displacement, direction, persistence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import Scale
from .kinematics import frame_rows, norm


def squared_displacements(obs: DataFrame, scale: Scale) -> DataFrame:
    """Mean squared displacement by the lag in frames that really lies between two observations: track_id, lag_frames, n_pairs, msd_px2, msd_um2.

    Pairs join on the track alone and go straight into a partial aggregation, so
    only (track, lag) sums are shuffled again. Squares are summed as whole
    hundredths, hence without rounding.
    """
    side = obs.select("track_id", "frame", "x_c", F.round(F.col("y_px") * 100).cast("bigint").alias("y_c"))
    a, b = side.alias("a"), side.alias("b")
    pairs = a.join(b, (F.col("a.track_id") == F.col("b.track_id")) & (F.col("a.frame") < F.col("b.frame")))
    dx, dy = F.col("b.x_c") - F.col("a.x_c"), F.col("b.y_c") - F.col("a.y_c")
    sums = pairs.groupBy(F.col("a.track_id").alias("track_id"), (F.col("b.frame") - F.col("a.frame")).alias("lag_frames")).agg(F.count("*").alias("n_pairs"), F.sum(dx * dx + dy * dy).alias("total"))
    msd = F.col("total").cast("double") / F.col("n_pairs") / 10_000.0
    um2 = msd * scale.pixel_um**2 if scale.pixel_calibrated else F.lit(None).cast("double")
    time = F.col("lag_frames") * scale.interval_min if scale.interval_calibrated else F.lit(None).cast("double")
    return sums.select("track_id", "lag_frames", time.alias("lag_time_min"), "n_pairs", msd.alias("msd_px2"), um2.alias("msd_um2"))


def displacement_exponent(msd: DataFrame, least_pairs: int = 3, part: float = 0.5, least_lags: int = 3) -> DataFrame:
    """Slope of ln(msd) on ln(lag): track_id, alpha, r2, n_lags.

    Lags up to ``part`` of the longest one that the track has, of enough pairs and a
    positive msd; no row with fewer than ``least_lags`` of them. r2 is null if all
    msd are equal.
    """
    longest = F.max("lag_frames").over(Window.partitionBy("track_id"))
    used = msd.withColumn("longest", longest).where((F.col("n_pairs") >= least_pairs) & (F.col("lag_frames") <= part * F.col("longest")) & (F.col("msd_px2") > 0))
    value = F.coalesce("msd_um2", "msd_px2")
    x, y = F.log(F.col("lag_frames").cast("double")), F.log(value)
    fit = used.groupBy("track_id").agg(F.regr_slope(y, x).alias("alpha"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n_lags"), (F.max(value) == F.min(value)).alias("flat"))
    return fit.where(F.col("n_lags") >= least_lags).select("track_id", "alpha", F.when(~F.col("flat"), F.col("r2")).alias("r2"), "n_lags")


def unit_steps(obs: DataFrame, scale: Scale) -> DataFrame:
    """Directions of steps of exactly one frame and some length, at the frame they end in."""
    rows = frame_rows(obs, scale).where((F.col("dt") == 1) & (F.col("distance_from_previous_px") > 0))
    length = norm(F.col("dx"), F.col("dy"))
    return rows.select("track_id", "frame", (F.col("dx") / length).alias("ux"), (F.col("dy") / length).alias("uy"))


def direction_autocorrelation(obs: DataFrame, scale: Scale) -> DataFrame:
    """Mean cosine between directions by lag: track_id, lag_frames, n_pairs, correlation."""
    side = unit_steps(obs, scale)
    a, b = side.alias("a"), side.alias("b")
    pairs = a.join(b, (F.col("a.track_id") == F.col("b.track_id")) & (F.col("a.frame") < F.col("b.frame")))
    cos = F.col("a.ux") * F.col("b.ux") + F.col("a.uy") * F.col("b.uy")
    return pairs.groupBy(F.col("a.track_id").alias("track_id"), (F.col("b.frame") - F.col("a.frame")).alias("lag_frames")).agg(F.count("*").alias("n_pairs"), F.avg(cos).alias("correlation"))


def persistence(autocorrelation: DataFrame, summary: DataFrame, scale: Scale, least_pairs: int = 3, part: float = 0.5, least_lags: int = 3) -> DataFrame:
    """Persistence time P of ln C = -t / P through the origin: track_id, persistence_min, r2, n_lags.

    The series is cut at the first lag whose correlation is not positive, before lags
    are left out for few pairs or for lying beyond ``part`` of the track's span. No
    row if the slope is not negative; r2 is against the mean of ln C and may be
    below 0.
    """
    cut = F.min(F.when(F.col("correlation") <= 0, F.col("lag_frames"))).over(Window.partitionBy("track_id"))
    used = autocorrelation.withColumn("cut", cut).where(F.col("cut").isNull() | (F.col("lag_frames") < F.col("cut")))
    used = used.join(summary.select("track_id", "span_frames"), "track_id").where((F.col("n_pairs") >= least_pairs) & (F.col("lag_frames") <= part * F.col("span_frames")))
    t, y = F.col("lag_frames") * scale.interval_min, F.log("correlation")
    used = used.select("track_id", t.alias("t"), y.alias("y"))
    sums = used.groupBy("track_id").agg(F.sum(F.col("t") * F.col("y")).alias("ty"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum("y").alias("sy"), F.count("*").alias("n_lags"))
    slope = F.col("ty") / F.col("tt")
    rest = F.col("yy") - slope * F.col("ty")
    spread = F.col("yy") - F.col("sy") * F.col("sy") / F.col("n_lags")
    return sums.where((F.col("n_lags") >= least_lags) & (slope < 0)).select("track_id", (-1 / slope).alias("persistence_min"), F.when(spread > 0, 1 - rest / spread).alias("r2"), "n_lags")


PAIR_SQL = """pos AS (SELECT track_id, frame, x_c, CAST(round(y_px * 100) AS BIGINT) AS y_c FROM obs),
msd AS (
  SELECT a.track_id, b.frame - a.frame AS lag_frames, count(*) AS n_pairs,
         CAST(sum((b.x_c - a.x_c) * (b.x_c - a.x_c) + (b.y_c - a.y_c) * (b.y_c - a.y_c)) AS DOUBLE) / count(*) / 10000.0 AS msd_px2
  FROM pos a JOIN pos b ON a.track_id = b.track_id AND a.frame < b.frame GROUP BY 1, 2
)"""
DIR_SQL = """step AS (SELECT track_id, frame, dx / distance_from_previous_px AS ux, dy / distance_from_previous_px AS uy FROM kin WHERE dt = 1 AND distance_from_previous_px > 0),
dir AS (
  SELECT a.track_id, b.frame - a.frame AS lag_frames, count(*) AS n_pairs, avg(a.ux * b.ux + a.uy * b.uy) AS correlation
  FROM step a JOIN step b ON a.track_id = b.track_id AND a.frame < b.frame GROUP BY 1, 2
)"""
