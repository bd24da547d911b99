"""One row per track, and the whole run's figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Scale, TrackingSettings
from .kinematics import frame_rows


def track_summary(obs: DataFrame, scale: Scale, settings: TrackingSettings = TrackingSettings()) -> DataFrame:
    """One row per track from its frame rows: extent, gaps, displacement, speeds, shape of the path, flags.

    A track of one observation has duration 0 and path 0, and no speeds. Straightness
    needs a path. The median speed is exact. The flag ``fragment`` marks fewer than
    ``min_observations`` observations.
    """
    rows = frame_rows(obs, scale)
    um = scale.pixel_um if scale.pixel_calibrated else None
    ends = rows.groupBy("track_id").agg(
        F.min("frame").alias("first_frame"),
        F.max("frame").alias("last_frame"),
        F.count("*").cast("int").alias("n_observations"),
        F.count_if(F.col("gap_frames") > 1).cast("int").alias("n_gaps"),
        F.sum(F.greatest(F.col("gap_frames") - 1, F.lit(0))).cast("int").alias("total_missing_frames"),
        F.max("cumulative_path_px").alias("path_px"),
        F.max_by("distance_from_start_px", "frame").alias("net_px"),
        F.max("distance_from_start_px").alias("max_distance_px"),
        F.avg("speed_px_per_frame").alias("mean_speed_px_per_frame"),
        F.avg("speed_um_per_min").alias("mean_speed_um_per_min"),
        F.median("speed_um_per_min").alias("median_speed_um_per_min"),
        F.max("speed_um_per_min").alias("max_speed_um_per_min"),
        F.avg("turning_angle_deg").alias("mean_turning_deg"),
        F.avg("area_px").alias("mean_area_px"),
        F.count_if(F.col("source") != "primary").cast("int").alias("n_borrowed"),
    )
    span = F.col("last_frame") - F.col("first_frame")
    length = F.lit(um) if um is not None else F.lit(None).cast("double")
    minutes = span * scale.interval_min if scale.interval_calibrated else F.lit(None).cast("double")
    out = ends.withColumns({"span_frames": span, "duration_min": minutes, "path_um": F.col("path_px") * length, "net_displacement_um": F.col("net_px") * length, "mean_area_um2": F.col("mean_area_px") * length * length})
    moving = F.col("span_frames") > 0
    return out.withColumns({
        "net_speed_um_per_min": F.when(moving, F.col("net_displacement_um") / F.col("duration_min")),
        "path_speed_um_per_min": F.when(moving, F.col("path_um") / F.col("duration_min")),
        "straightness": F.when(F.col("path_px") > 1e-9, F.col("net_px") / F.col("path_px")),
        "flags": F.when(F.col("n_observations") < settings.min_observations, "fragment").otherwise(""),
    })


def run_speeds(summary: DataFrame) -> DataFrame:
    """The run's speeds: mean and exact median over tracks of their mean and net speeds."""
    return summary.agg(
        F.count("mean_speed_um_per_min").alias("n_tracks_with_speed"),
        F.avg("mean_speed_um_per_min").alias("mean_of_mean_speed"),
        F.median("mean_speed_um_per_min").alias("median_of_mean_speed"),
        F.avg("net_speed_um_per_min").alias("mean_of_net_speed"),
        F.median("net_speed_um_per_min").alias("median_of_net_speed"),
    )


def objects_per_frame(obs: DataFrame) -> DataFrame:
    """Objects in every frame from 0 to the last, 0 where there are none."""
    counts = obs.groupBy("frame").agg(F.count("*").alias("n"))
    frames = obs.agg(F.max("frame").alias("last")).where("last is not null").select(F.explode(F.sequence(F.lit(0), F.col("last"))).alias("frame"))
    return frames.join(counts, "frame", "left").select("frame", F.coalesce("n", F.lit(0)).alias("n_objects"))


SUM_SQL = """summary AS (
  SELECT *, path_px * 0.5 AS path_um, net_px * 0.5 AS net_displacement_um, span_frames * 60.0 AS duration_min, mean_area_px * 0.5 * 0.5 AS mean_area_um2,
         CASE WHEN span_frames > 0 THEN net_px * 0.5 / (span_frames * 60.0) END AS net_speed_um_per_min,
         CASE WHEN span_frames > 0 THEN path_px * 0.5 / (span_frames * 60.0) END AS path_speed_um_per_min,
         CASE WHEN path_px > 1e-9 THEN net_px / path_px END AS straightness,
         CASE WHEN n_observations < 2 THEN 'fragment' ELSE '' END AS flags
  FROM (
    SELECT track_id, min(frame) AS first_frame, max(frame) AS last_frame, CAST(count(*) AS INTEGER) AS n_observations,
           max(frame) - min(frame) AS span_frames,
           CAST(count(*) FILTER (WHERE gap_frames > 1) AS INTEGER) AS n_gaps, CAST(sum(greatest(gap_frames - 1, 0)) AS INTEGER) AS total_missing_frames,
           max(cumulative_path_px) AS path_px, avg(speed_px_per_frame) AS mean_speed_px_per_frame, max_by(distance_from_start_px, frame) AS net_px, max(distance_from_start_px) AS max_distance_px,
           avg(speed_um_per_min) AS mean_speed_um_per_min, median(speed_um_per_min) AS median_speed_um_per_min, max(speed_um_per_min) AS max_speed_um_per_min,
           avg(turning_angle_deg) AS mean_turning_deg, avg(area_px) AS mean_area_px, CAST(count(*) FILTER (WHERE source <> 'primary') AS INTEGER) AS n_borrowed
    FROM kin GROUP BY track_id)
)"""

#: The columns of a saved summary in their order.
SUMMARY_COLUMNS = (
    "track_id", "channel", "dimensionality", "first_frame", "last_frame", "first_source_frame", "last_source_frame", "n_observations", "n_gaps", "total_missing_frames", "span_frames",
    "duration_min", "duration_hr", "net_displacement_px", "net_displacement_um", "path_length_px", "path_length_um", "max_distance_from_start_px", "max_distance_from_start_um", "straightness",
    "mean_speed_um_per_min", "median_speed_um_per_min", "max_speed_um_per_min", "mean_speed_um_per_hr", "median_speed_um_per_hr", "max_speed_um_per_hr",
    "net_speed_um_per_min", "net_speed_um_per_hr", "path_speed_um_per_min", "path_speed_um_per_hr", "mean_speed_px_per_frame", "net_speed_px_per_frame", "mean_turning_angle_deg", "directional_autocorrelation",
    "persistence_time_frames", "persistence_time_min", "persistence_time_hr", "persistence_fit_r2", "persistence_fit_lags", "msd_alpha", "msd_alpha_r2", "msd_fit_lags",
    "mean_area_px", "mean_area_um2", "mean_volume_um3", "min_link_margin_chi2", "flags",
)


def full_summary(obs: DataFrame, scale: Scale, settings: TrackingSettings = TrackingSettings()) -> DataFrame:
    """The saved summary: all of SUMMARY_COLUMNS, one row per track.

    ``obs`` may have channel, source_frame, volume_vox and link_margin; what it lacks
    is -1 for the channel and else null. Directions and displacements are fitted from
    three lags on. Everything is grouped by track, so the parts join where they lie.
    """
    from .pairs import direction_autocorrelation, displacement_exponent, persistence, squared_displacements

    have = set(obs.columns)
    null = F.lit(None).cast("double")
    base = track_summary(obs, scale, settings)
    lengths = F.lit(scale.pixel_um) if scale.pixel_calibrated else null
    volume = scale.pixel_um**2 * scale.z_um if scale.pixel_calibrated and scale.z_um is not None else None
    extra = obs.groupBy("track_id").agg(
        (F.max_by("channel", "frame") if "channel" in have else F.lit(-1)).cast("int").alias("channel"),
        (F.min_by("source_frame", "frame") if "source_frame" in have else F.lit(None)).cast("int").alias("first_source_frame"),
        (F.max_by("source_frame", "frame") if "source_frame" in have else F.lit(None)).cast("int").alias("last_source_frame"),
        (F.avg("volume_vox") * volume if "volume_vox" in have and volume else null).alias("mean_volume_um3"),
        (F.min("link_margin") if "link_margin" in have else null).alias("min_link_margin_chi2"),
    )
    directions = direction_autocorrelation(obs, scale)
    first_lag = directions.where("lag_frames = 1").select("track_id", F.col("correlation").alias("directional_autocorrelation"))
    lasting = persistence(directions, base, scale).select("track_id", (F.col("persistence_min") / scale.interval_min).alias("persistence_time_frames"), F.col("r2").alias("persistence_fit_r2"), F.col("n_lags").alias("persistence_fit_lags"))
    spread = displacement_exponent(squared_displacements(obs, scale), least_pairs=3).select("track_id", F.col("alpha").alias("msd_alpha"), F.col("r2").alias("msd_alpha_r2"), F.col("n_lags").alias("msd_fit_lags"))
    rows = base.join(extra, "track_id")
    for part in (first_lag, lasting, spread):
        rows = rows.join(part, "track_id", "left")
    minutes = F.lit(scale.interval_min) if scale.interval_calibrated else null
    moving = F.col("span_frames") > 0
    rows = rows.withColumns({
        "dimensionality": F.lit("3D" if "volume_vox" in have else "2D"), "duration_hr": F.col("duration_min") / 60.0,
        "net_displacement_px": F.col("net_px"), "path_length_px": F.col("path_px"), "path_length_um": F.col("path_um"),
        "max_distance_from_start_px": F.col("max_distance_px"), "max_distance_from_start_um": F.col("max_distance_px") * lengths,
        **{f"{k}_speed_um_per_hr": F.col(f"{k}_speed_um_per_min") * 60.0 for k in ("mean", "median", "max", "net", "path")},
        "net_speed_px_per_frame": F.when(moving, F.col("net_px") / F.col("span_frames")),
        "mean_turning_angle_deg": F.col("mean_turning_deg"), "persistence_time_min": F.col("persistence_time_frames") * minutes,
    }).withColumn("persistence_time_hr", F.col("persistence_time_min") / 60.0)
    return rows.select(*SUMMARY_COLUMNS)
