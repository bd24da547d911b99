"""What a track does next, and what it has done: targets at horizons and motion history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Scale
from .kinematics import by_track, frame_rows, norm

#: Horizons in frames, the net rate that counts as migrating, steps of history.
HORIZONS, MIGRATING_UM_PER_HR, HISTORY_STEPS = (1, 3, 6), 6.0, 3


def horizon_targets(obs: DataFrame, scale: Scale, horizons: tuple[int, ...] = HORIZONS, migrating: float = MIGRATING_UM_PER_HR) -> DataFrame:
    """Per observation and horizon, if the track is seen exactly then: disp_um, speed_um_per_hr, migrating, gap (frames in between unseen), recovered (a borrowed detection on the way).

    The path between two observations is a difference of running sums, so one
    equi-join per horizon is all; nulls where the track is not seen.
    """
    rows = frame_rows(obs, scale).withColumn("borrowed", F.sum((F.col("source") != "primary").cast("int")).over(by_track()))
    side = rows.select("track_id", "frame", "x_px", "y_px", "cumulative_path_px", "observation_index", "borrowed")
    now = side.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("at", F.col("frame") + F.col("horizon"))
    then = side.select("track_id", F.col("frame").alias("at"), *[F.col(c).alias(f"n_{c}") for c in ("x_px", "y_px", "cumulative_path_px", "observation_index", "borrowed")])
    both = now.join(then, ["track_id", "at"], "left")
    hours = F.col("horizon") * scale.interval_min / 60.0
    disp = norm(F.col("n_x_px") - F.col("x_px"), F.col("n_y_px") - F.col("y_px")) * scale.pixel_um
    path = (F.col("n_cumulative_path_px") - F.col("cumulative_path_px")) * scale.pixel_um
    return both.select("track_id", "frame", "horizon", disp.alias("disp_um"), (path / hours).alias("speed_um_per_hr"), (disp / hours >= migrating).alias("migrating"), (F.col("n_observation_index") - F.col("observation_index") < F.col("horizon")).alias("target_gap"), (F.col("n_borrowed") > F.col("borrowed")).alias("target_recovered"))


def motion_history(obs: DataFrame, scale: Scale, steps: int = HISTORY_STEPS) -> DataFrame:
    """Per observation with a past: last step's speed, mean of up to ``steps`` past steps' speeds, and net rate over the same stretch, in um an hour."""
    w = by_track()
    rows = frame_rows(obs, scale)
    back = {c: F.coalesce(*[F.lag(c, k).over(w) for k in range(steps, 0, -1)]) for c in ("x_px", "y_px", "frame")}
    net = norm(F.col("x_px") - back["x_px"], F.col("y_px") - back["y_px"]) * scale.pixel_um / ((F.col("frame") - back["frame"]) * scale.interval_min / 60.0)
    out = rows.withColumns({"hist_mean": F.avg("speed_um_per_hr").over(w.rowsBetween(-(steps - 1), 0)), "hist_net": net})
    return out.where("observation_index > 0").select("track_id", "frame", F.col("speed_um_per_hr").alias("hist_speed_last"), "hist_mean", "hist_net")
