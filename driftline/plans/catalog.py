"""The registered queries of the engine's own operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gaps, kinematics, pairs, summary
from ..operators.tracklets import split_on_gaps
from ..schema import EVENT_SCALE as SCALE
from ..schema import TrackingSettings
from ..sources.events import OBS_SQL, events, observations

SETTINGS = TrackingSettings()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(events(spark, sf_dir))


def rounded(df: DataFrame, digits: int = 6, *keep: str) -> DataFrame:
    """Doubles to ``digits`` places: engines may differ in the last bit of a root, a logarithm or a sum."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


WITH_OBS = f"WITH {OBS_SQL}"
WITH_KIN = f"{WITH_OBS}, {kinematics.KIN_SQL}"
WITH_SUM = f"{WITH_KIN}, {summary.SUM_SQL}"
WITH_MSD = f"{WITH_OBS}, {pairs.PAIR_SQL}"
WITH_DIR = f"{WITH_KIN}, {pairs.DIR_SQL}"

KIN = ("distance_from_previous_px", "distance_from_start_px", "cumulative_path_px", "speed_um_per_min", "speed_um_per_hr")


@query(f"{WITH_OBS} SELECT * FROM obs")
def obs_adapter(spark, sf_dir):
    return obs(spark, sf_dir)


@query(f"{WITH_KIN} SELECT track_id, frame, CAST(observation_index AS INTEGER) AS observation_index, CAST(n_observations AS INTEGER) AS n_observations, gap_frames, {r(*KIN)} FROM kin")
def frame_kinematics(spark, sf_dir):
    return rounded(kinematics.frame_rows(obs(spark, sf_dir), SCALE).select("track_id", "frame", "observation_index", "n_observations", "gap_frames", *KIN))


@query(f"{WITH_KIN} SELECT track_id, frame, round(cumulative_path_px * 0.5, 6) AS cumulative_path_um FROM kin")
def cumulative_path(spark, sf_dir):
    return rounded(kinematics.frame_rows(obs(spark, sf_dir), SCALE).select("track_id", "frame", "cumulative_path_um"))


@query(f"{WITH_KIN} SELECT track_id, frame, round(distance_from_start_px * 0.5, 6) AS distance_from_start_um FROM kin")
def distance_from_start(spark, sf_dir):
    return rounded(kinematics.frame_rows(obs(spark, sf_dir), SCALE).select("track_id", "frame", "distance_from_start_um"))


@query(f"{WITH_KIN} SELECT track_id, frame, round(turning_angle_deg, 5) AS turning_angle_deg FROM kin")
def turning_angle(spark, sf_dir):
    return rounded(kinematics.frame_rows(obs(spark, sf_dir), SCALE).select("track_id", "frame", "turning_angle_deg"), 5)


@query(f"{WITH_KIN} SELECT track_id, frame, {r('acceleration_um_per_hr2')} FROM kin")
def acceleration(spark, sf_dir):
    return rounded(kinematics.frame_rows(obs(spark, sf_dir), SCALE).select("track_id", "frame", "acceleration_um_per_hr2"))


@query(f"{WITH_OBS} SELECT track_id, frame, round(sqrt((x_px - 10.0) * (x_px - 10.0) + (y_px - 50.0) * (y_px - 50.0)), 6) AS distance_from_reference_px, round(sqrt((x_px - 10.0) * (x_px - 10.0) + (y_px - 50.0) * (y_px - 50.0)) * 0.5, 6) AS distance_from_reference_um FROM obs")
def reference_distance(spark, sf_dir):
    return rounded(kinematics.reference_distance(obs(spark, sf_dir).select("track_id", "frame", "x_px", "y_px"), 10.0, 50.0, SCALE).drop("x_px", "y_px"))


@query(f"{WITH_OBS}, n AS (SELECT track_id, frame, lead(frame) OVER (PARTITION BY track_id ORDER BY frame) AS nx FROM obs) SELECT track_id, CAST(unnest(generate_series(frame + 1, nx - 1)) AS INTEGER) AS frame FROM n WHERE nx > frame + 1")
def missing_frames(spark, sf_dir):
    return gaps.missing_frames(obs(spark, sf_dir))


@query(f"""{WITH_OBS}, n AS (SELECT *, lead(frame) OVER w AS nf, lead(x_px) OVER w AS nx, lead(y_px) OVER w AS ny, lead(area_px) OVER w AS na, lead(det_label) OVER w AS nl FROM obs WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
m AS (SELECT *, CAST(unnest(generate_series(frame + 1, nf - 1)) AS INTEGER) AS g FROM n WHERE nf > frame + 1)
SELECT track_id, g AS frame, round(x_px + (nx - x_px) * (CAST(g - frame AS DOUBLE) / (nf - frame)), 9) AS x_px, round(y_px + (ny - y_px) * (CAST(g - frame AS DOUBLE) / (nf - frame)), 9) AS y_px,
       round(0.5 * (area_px + na), 9) AS area_px, frame AS before_frame, det_label AS before_label, nf AS after_frame, nl AS after_label FROM m""")
def interpolated_gap_positions(spark, sf_dir):
    return rounded(gaps.expected_positions(obs(spark, sf_dir)), 9)


@query(f"{WITH_MSD} SELECT track_id, lag_frames, lag_frames * 60.0::DOUBLE AS lag_time_min, n_pairs, msd_px2, msd_px2 * 0.25::DOUBLE AS msd_um2 FROM msd")
def msd_by_lag(spark, sf_dir):
    return pairs.squared_displacements(obs(spark, sf_dir), SCALE)


@query(f"""{WITH_MSD}, u AS (SELECT *, max(lag_frames) OVER (PARTITION BY track_id) AS longest, msd_px2 * 0.25 AS v FROM msd),
f AS (SELECT track_id, regr_slope(ln(v), ln(lag_frames)) AS alpha, regr_r2(ln(v), ln(lag_frames)) AS r2, count(*) AS n_lags, max(v) = min(v) AS flat FROM u WHERE n_pairs >= 3 AND lag_frames <= 0.5 * longest AND v > 0 GROUP BY track_id)
SELECT track_id, {r('alpha')}, round(CASE WHEN NOT flat THEN r2 END, 6) AS r2, n_lags FROM f WHERE n_lags >= 3""")
def msd_alpha(spark, sf_dir):
    return rounded(pairs.displacement_exponent(pairs.squared_displacements(obs(spark, sf_dir), SCALE)))


@query(f"{WITH_DIR} SELECT track_id, lag_frames, n_pairs, {r('correlation')} FROM dir")
def direction_autocorr(spark, sf_dir):
    return rounded(pairs.direction_autocorrelation(obs(spark, sf_dir), SCALE))


@query(f"""{WITH_DIR}, {summary.SUM_SQL}, c AS (SELECT *, min(CASE WHEN correlation <= 0 THEN lag_frames END) OVER (PARTITION BY track_id) AS cut FROM dir),
u AS (SELECT c.track_id, lag_frames * 60.0 AS t, ln(correlation) AS y FROM c JOIN summary USING (track_id) WHERE (cut IS NULL OR lag_frames < cut) AND n_pairs >= 1 AND lag_frames <= 0.5 * span_frames),
s AS (SELECT track_id, sum(t * y) / sum(t * t) AS slope, sum(t * y) AS ty, sum(y * y) AS yy, sum(y) AS sy, count(*) AS n_lags FROM u GROUP BY track_id)
SELECT track_id, round(-1 / slope, 4) AS persistence_min, round(CASE WHEN yy - sy * sy / n_lags > 1e-12 THEN 1 - (yy - slope * ty) / (yy - sy * sy / n_lags) END, 4) AS r2, n_lags FROM s WHERE n_lags >= 1 AND slope < 0""")
def persistence_time(spark, sf_dir):
    o = obs(spark, sf_dir)
    return rounded(pairs.persistence(pairs.direction_autocorrelation(o, SCALE), summary.track_summary(o, SCALE, SETTINGS), SCALE, least_pairs=1, least_lags=1), 4)


SUMMARY = ("path_um", "net_displacement_um", "duration_min", "mean_area_um2", "net_speed_um_per_min", "path_speed_um_per_min", "straightness", "mean_speed_um_per_min", "median_speed_um_per_min", "max_speed_um_per_min", "max_distance_px")
COUNTS = ("track_id", "first_frame", "last_frame", "n_observations", "span_frames", "n_gaps", "total_missing_frames", "n_borrowed", "flags")


@query(f"{WITH_SUM} SELECT {', '.join(COUNTS)}, {r(*SUMMARY)}, round(mean_turning_deg, 4) AS mean_turning_deg FROM summary")
def track_summary(spark, sf_dir):
    out = summary.track_summary(obs(spark, sf_dir), SCALE, SETTINGS)
    return rounded(out.select(*COUNTS, *SUMMARY, F.round("mean_turning_deg", 4).alias("mean_turning_deg")))


@query(f"{WITH_SUM} SELECT count(mean_speed_um_per_min) AS n_tracks_with_speed, round(avg(mean_speed_um_per_min), 6) AS mean_of_mean_speed, round(median(mean_speed_um_per_min), 6) AS median_of_mean_speed, round(avg(net_speed_um_per_min), 6) AS mean_of_net_speed, round(median(net_speed_um_per_min), 6) AS median_of_net_speed FROM summary")
def run_speed_summary(spark, sf_dir):
    return rounded(summary.run_speeds(summary.track_summary(obs(spark, sf_dir), SCALE, SETTINGS)))


@query(f"{WITH_OBS} SELECT CAST(f AS INTEGER) AS frame, (SELECT count(*) FROM obs WHERE obs.frame = f) AS n_objects FROM (SELECT unnest(generate_series(0, (SELECT max(frame) FROM obs))) AS f)")
def objects_per_frame(spark, sf_dir):
    return summary.objects_per_frame(obs(spark, sf_dir))


ENDS_SQL = "ends AS (SELECT track_id, min(frame) AS f0, max(frame) AS f1, arg_min(x_px, frame) AS sx, arg_min(y_px, frame) AS sy, arg_max(x_px, frame) AS ex, arg_max(y_px, frame) AS ey FROM obs GROUP BY track_id)"


@query(f"{WITH_OBS} SELECT frame, count(*) AS n_gaps FROM (SELECT track_id, CAST(unnest(generate_series(frame + 1, nx - 1)) AS INTEGER) AS frame FROM (SELECT track_id, frame, lead(frame) OVER (PARTITION BY track_id ORDER BY frame) AS nx FROM obs) WHERE nx > frame + 1) GROUP BY frame")
def gap_count_per_frame(spark, sf_dir):
    return gaps.gaps_per_frame(obs(spark, sf_dir))


def tracklets(spark, sf_dir):
    """Pieces of tracks: a pause of more than 8 frames starts a new one, so tracks begin and end all through the movie."""
    return split_on_gaps(obs(spark, sf_dir), 8)


TRACKLET_SQL = """whole AS (SELECT * FROM obs), cut AS (
  SELECT *, sum(CASE WHEN pf IS NULL OR frame - pf > 8 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY frame) AS piece
  FROM (SELECT *, lag(frame) OVER (PARTITION BY track_id ORDER BY frame) AS pf FROM whole)
), tl AS (SELECT * REPLACE (track_id * 100000 + piece AS track_id) FROM cut)"""
TL_ENDS = ENDS_SQL.replace("FROM obs", "FROM tl")


@query(f"""{WITH_OBS}, {TRACKLET_SQL}, {TL_ENDS}, p AS (
  SELECT b.track_id, b.f0 AS frame, a.track_id AS candidate_track_id, a.f1 AS candidate_last_frame,
         sqrt((b.sx - a.ex) * (b.sx - a.ex) + (b.sy - a.ey) * (b.sy - a.ey)) AS distance_px
  FROM ends b LEFT JOIN ends a ON a.f1 < b.f0 WHERE b.f0 > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame - candidate_last_frame NULLS LAST, distance_px NULLS LAST, candidate_track_id) AS k FROM p)
SELECT track_id, frame, candidate_track_id, candidate_last_frame, frame - candidate_last_frame AS gap_frames, {r('distance_px')}, round(distance_px * 0.5 / ((frame - candidate_last_frame) * 60.0), 6) AS speed_um_per_min,
       CASE WHEN frame - candidate_last_frame > 4 THEN 'gap_too_long' WHEN distance_px * 0.5 / ((frame - candidate_last_frame) * 60.0) > 5.0 THEN 'too_fast' END AS refused_because
FROM k WHERE k = 1""")
def unlinked_starts_nearest(spark, sf_dir):
    return rounded(gaps.unlinked_starts(tracklets(spark, sf_dir), SETTINGS, SCALE))


@query(f"""{WITH_OBS}, {TRACKLET_SQL}, {TL_ENDS}
SELECT a.track_id AS from_track, b.track_id AS to_track, a.f1 AS last_frame, b.f0 AS first_frame, b.f0 - a.f1 AS gap_frames,
       round(sqrt((b.sx - a.ex) * (b.sx - a.ex) + (b.sy - a.ey) * (b.sy - a.ey)), 6) AS distance_px,
       round(sqrt((b.sx - a.ex) * (b.sx - a.ex) + (b.sy - a.ey) * (b.sy - a.ey)) * 0.5 / ((b.f0 - a.f1) * 60.0), 9) AS speed_um_per_min
FROM ends a JOIN ends b ON a.track_id <> b.track_id AND b.f0 - a.f1 BETWEEN 1 AND 4
WHERE sqrt((b.sx - a.ex) * (b.sx - a.ex) + (b.sy - a.ey) * (b.sy - a.ey)) * 0.5 / ((b.f0 - a.f1) * 60.0) <= 5.0""")
def gap_closing_candidates(spark, sf_dir):
    # dealt out once, by user: neither hours, pieces nor their ends need the rows sent again
    whole = observations(events(spark, sf_dir).repartition("user_id")).withColumn("whole_track", F.col("track_id"))
    out = gaps.closing_candidates(split_on_gaps(whole, 8), SETTINGS, SCALE, "whole_track")
    return rounded(out.withColumn("speed_um_per_min", F.round("speed_um_per_min", 9)), 6, "speed_um_per_min")
