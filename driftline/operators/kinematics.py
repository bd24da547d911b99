"""Frame-to-frame kinematics of tracks, as window expressions over (track_id order by frame)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..schema import Scale


def by_track() -> WindowSpec:
    return Window.partitionBy("track_id").orderBy("frame")


def so_far() -> WindowSpec:
    return by_track().rowsBetween(Window.unboundedPreceding, 0)


def whole() -> WindowSpec:
    return Window.partitionBy("track_id")


def norm(*parts: Column) -> Column:
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def angle_deg(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Unsigned angle between two steps; null where one has no length. The cosine is clipped: rounding may carry it past 1."""
    lengths = norm(ax, ay) * norm(bx, by)
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / F.nullif(lengths, F.lit(0.0))))
    return F.when(lengths > 0, F.degrees(F.acos(cos)))


def frame_rows(obs: DataFrame, scale: Scale) -> DataFrame:
    """``obs`` with the kinematic columns of every observation.

    Speeds divide by the real frames elapsed, so gaps do not slow a track. Values in
    micrometres or minutes are null if uncalibrated; a track's first row has no step,
    distance 0 from its start and path 0. Hourly values are 60 times those a minute.
    """
    um = scale.pixel_um if scale.pixel_calibrated else None
    timed = um is not None and scale.interval_calibrated
    x, y, t = F.col("x_px"), F.col("y_px"), F.col("frame")
    dx, dy, dt = x - F.lag(x).over(by_track()), y - F.lag(y).over(by_track()), t - F.lag(t).over(by_track())
    rows = obs.withColumns({
        "observation_index": F.row_number().over(by_track()) - 1,
        "n_observations": F.count(F.lit(1)).over(whole()).cast("int"),
        "gap_frames": F.coalesce(dt, F.lit(0)),
        "dx": F.when(dt > 0, dx), "dy": F.when(dt > 0, dy), "dt": F.when(dt > 0, dt), "dt2": t - F.lag(t, 2).over(by_track()),
        "distance_from_start_px": norm(x - F.first("x_px").over(so_far()), y - F.first("y_px").over(so_far())),
    })
    rows = rows.withColumn("distance_from_previous_px", norm(F.col("dx"), F.col("dy")))
    # one length unit to another is one factor; whether it exists is known before the plan is made
    length = F.lit(um) if um is not None else F.lit(None).cast("double")
    minute = F.lit(um / scale.interval_min) if timed else F.lit(None).cast("double")
    rows = rows.withColumns({
        "cumulative_path_px": F.sum(F.coalesce("distance_from_previous_px", F.lit(0.0))).over(so_far()),
        "turning_angle_deg": angle_deg(F.lag("dx").over(by_track()), F.lag("dy").over(by_track()), F.col("dx"), F.col("dy")),
        "vx_um_per_min": F.col("dx") / F.col("dt") * minute, "vy_um_per_min": F.col("dy") / F.col("dt") * minute,
        "speed_px_per_frame": F.col("distance_from_previous_px") / F.col("dt"),
    })
    rows = rows.withColumns({
        "distance_from_previous_um": F.col("distance_from_previous_px") * length, "cumulative_path_um": F.col("cumulative_path_px") * length, "distance_from_start_um": F.col("distance_from_start_px") * length,
        "speed_um_per_min": F.col("speed_px_per_frame") * minute,
    }).withColumn("speed_um_per_hr", F.col("speed_um_per_min") * 60.0)
    # midpoint to midpoint: half the frames from the step before last to here
    hours = F.col("dt2") * scale.interval_min / 60.0 / 2.0
    rows = rows.withColumn("acceleration_um_per_hr2", (F.col("speed_um_per_hr") - F.lag("speed_um_per_hr").over(by_track())) / hours)
    return rows.drop("dt2")


def reference_distance(obs: DataFrame, x0: float | None, y0: float | None, scale: Scale) -> DataFrame:
    """Distance of every observation from a fixed point; no point clears it."""
    px = norm(F.col("x_px") - F.lit(x0), F.col("y_px") - F.lit(y0)) if x0 is not None and y0 is not None else F.lit(None).cast("double")
    um = px * scale.pixel_um if scale.pixel_calibrated else F.lit(None).cast("double")
    return obs.withColumns({"distance_from_reference_px": px, "distance_from_reference_um": um})


KIN_SQL = """k0 AS (
  SELECT *, row_number() OVER w - 1 AS observation_index, count(*) OVER (PARTITION BY track_id) AS n_observations,
         coalesce(frame - lag(frame) OVER w, 0) AS gap_frames,
         x_px - lag(x_px) OVER w AS dx, y_px - lag(y_px) OVER w AS dy, frame - lag(frame) OVER w AS dt, frame - lag(frame, 2) OVER w AS dt2,
         first_value(x_px) OVER w AS x0, first_value(y_px) OVER w AS y0
  FROM obs WINDOW w AS (PARTITION BY track_id ORDER BY frame)
), k1 AS (
  SELECT *, sqrt(dx * dx + dy * dy) AS distance_from_previous_px, sqrt((x_px - x0) * (x_px - x0) + (y_px - y0) * (y_px - y0)) AS distance_from_start_px,
         lag(dx) OVER w AS px, lag(dy) OVER w AS py
  FROM k0 WINDOW w AS (PARTITION BY track_id ORDER BY frame)
), k2 AS (
  SELECT *, sum(coalesce(distance_from_previous_px, 0)) OVER (PARTITION BY track_id ORDER BY frame) AS cumulative_path_px,
         CASE WHEN sqrt(px * px + py * py) * sqrt(dx * dx + dy * dy) > 0
              THEN degrees(acos(greatest(-1.0, least(1.0, (px * dx + py * dy) / (sqrt(px * px + py * py) * sqrt(dx * dx + dy * dy)))))) END AS turning_angle_deg,
         distance_from_previous_px / dt AS speed_px_per_frame
  FROM k1
), kin AS (
  SELECT *, speed_px_per_frame * (0.5 / 60.0) AS speed_um_per_min, speed_px_per_frame * (0.5 / 60.0) * 60.0 AS speed_um_per_hr,
         (speed_px_per_frame * (0.5 / 60.0) * 60.0 - lag(speed_px_per_frame * (0.5 / 60.0) * 60.0) OVER (PARTITION BY track_id ORDER BY frame)) / (dt2 * 60.0 / 60.0 / 2.0) AS acceleration_um_per_hr2
  FROM k2
)"""
