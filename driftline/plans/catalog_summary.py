"""Queries of the whole saved summary, of the findings that need a table of their own, and of row-wise projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates, quality, regions, summary
from .catalog import SCALE, WITH_KIN, WITH_OBS, obs, pairs, query, rounded
from .catalog_links import PIXEL_SQL, pixels

_EXACT = ("track_id", "channel", "dimensionality", "first_frame", "last_frame", "first_source_frame", "last_source_frame", "n_observations", "n_gaps", "total_missing_frames", "span_frames", "persistence_fit_lags", "msd_fit_lags", "flags")
#: Fits and angles, where engines differ in more than the last bits.
_LOOSE = ("mean_turning_angle_deg", "directional_autocorrelation", "persistence_time_frames", "persistence_time_min", "persistence_time_hr", "persistence_fit_r2", "msd_alpha", "msd_alpha_r2")
_FULL_SQL = f"""{WITH_KIN}, {summary.SUM_SQL}, {pairs.PAIR_SQL}, {pairs.DIR_SQL},
x AS (SELECT track_id, CAST(-1 AS INTEGER) AS channel, '2D' AS dimensionality, CAST(min(frame) + 11 AS INTEGER) AS first_source_frame, CAST(max(frame) + 11 AS INTEGER) AS last_source_frame, min(CASE WHEN frame % 3 > 0 THEN (abs(x_c) % 50) / 10.0::DOUBLE END) AS min_link_margin_chi2 FROM obs GROUP BY track_id),
m AS (SELECT *, max(lag_frames) OVER (PARTITION BY track_id) AS longest, msd_px2 * 0.25 AS v FROM msd),
alpha AS (SELECT track_id, regr_slope(ln(v), ln(lag_frames)) AS msd_alpha, CASE WHEN max(v) > min(v) THEN regr_r2(ln(v), ln(lag_frames)) END AS msd_alpha_r2, count(*) AS msd_fit_lags FROM m WHERE n_pairs >= 3 AND lag_frames <= 0.5 * longest AND v > 0 GROUP BY track_id HAVING count(*) >= 3),
c AS (SELECT *, min(CASE WHEN correlation <= 0 THEN lag_frames END) OVER (PARTITION BY track_id) AS cut FROM dir),
u AS (SELECT c.track_id, lag_frames AS t, ln(correlation) AS y FROM c JOIN summary USING (track_id) WHERE (cut IS NULL OR lag_frames < cut) AND n_pairs >= 3 AND lag_frames <= 0.5 * span_frames),
s AS (SELECT track_id, sum(t * y) / sum(t * t) AS slope, sum(t * y) AS ty, sum(y * y) AS yy, sum(y) AS sy, count(*) AS n FROM u GROUP BY track_id),
lasting AS (SELECT track_id, -1 / slope AS persistence_time_frames, CASE WHEN yy - sy * sy / n > 0 THEN 1 - (yy - slope * ty) / (yy - sy * sy / n) END AS persistence_fit_r2, n AS persistence_fit_lags FROM s WHERE n >= 3 AND slope < 0),
w AS (SELECT summary.*, x.* EXCLUDE (track_id), duration_min / 60 AS duration_hr, net_px AS net_displacement_px, path_px AS path_length_px, path_um AS path_length_um, max_distance_px AS max_distance_from_start_px, max_distance_px * 0.5 AS max_distance_from_start_um,
 mean_speed_um_per_min * 60 AS mean_speed_um_per_hr, median_speed_um_per_min * 60 AS median_speed_um_per_hr, max_speed_um_per_min * 60 AS max_speed_um_per_hr, net_speed_um_per_min * 60 AS net_speed_um_per_hr, path_speed_um_per_min * 60 AS path_speed_um_per_hr,
 CASE WHEN span_frames > 0 THEN net_px / span_frames END AS net_speed_px_per_frame, mean_turning_deg AS mean_turning_angle_deg, correlation AS directional_autocorrelation, persistence_time_frames, persistence_time_frames * 60 AS persistence_time_min, persistence_time_frames AS persistence_time_hr,
 persistence_fit_r2, persistence_fit_lags, msd_alpha, msd_alpha_r2, msd_fit_lags, CAST(NULL AS DOUBLE) AS mean_volume_um3
 FROM summary JOIN x USING (track_id) LEFT JOIN (SELECT track_id, correlation FROM dir WHERE lag_frames = 1) d USING (track_id) LEFT JOIN lasting USING (track_id) LEFT JOIN alpha USING (track_id))
SELECT {', '.join(c if c in _EXACT else f'round({c}, {4 if c in _LOOSE else 6}) AS {c}' for c in summary.SUMMARY_COLUMNS)} FROM w"""


@query(_FULL_SQL)
def full_track_summary(spark, sf_dir):
    o = obs(spark, sf_dir).withColumns({"source_frame": F.col("frame") + 11, "link_margin": F.when(F.col("frame") % 3 > 0, (F.abs("x_c") % 50) / F.lit(10.0))})
    out = summary.full_summary(o, SCALE)
    return rounded(out.select(*[F.round(c, 4).alias(c) if c in _LOOSE else c for c in out.columns]), 6, *_LOOSE)


def _finding_sql(code: str, title: str, rows: str, frame: str = "frame", track: str = "track_id") -> str:
    severity, place = quality.RULES[code], list(quality.RULES).index(code)
    return f"SELECT '{severity}' AS severity, '{code}' AS code, {title} AS title, CAST({frame} AS INTEGER) AS frame, CAST({track} AS BIGINT) AS track_id, CAST({place} AS INTEGER) AS rule_seq FROM {rows}"


@query(f"{WITH_OBS}, {PIXEL_SQL}, s AS (SELECT frame, count(*) FILTER (WHERE extent_px < 6) AS removed FROM (SELECT frame, label, greatest(max(x) - min(x), max(y) - min(y)) + 1 AS extent_px FROM px GROUP BY frame, label) GROUP BY frame) " + _finding_sql("filtered_instances", "removed || ' small object(s) removed'", "s WHERE removed > 0", track="NULL"))
def qc_filtered_instances(spark, sf_dir):
    return quality.filtered_instances(regions.filter_diagnostics(regions.region_metrics(pixels(spark, sf_dir)), 6))


def _suspects(spark, sf_dir):
    """Event rows of every frame: tracks seen by the fallback passes stand for suspects."""
    return obs(spark, sf_dir).groupBy("frame").agg(*[F.array_sort(F.collect_set(F.when(F.col("source") == s, F.col("track_id")))).alias(f"{what}_suspected") for s, what in (("window", "merge"), ("permissive", "split"))])


@query(f"{WITH_OBS} " + _finding_sql("merge_suspected", "'Track ' || track_id || ' may have merged with another cell'", "obs WHERE source = 'window'"))
def qc_merge_suspected(spark, sf_dir):
    return quality.suspected(_suspects(spark, sf_dir), "merge")


@query(f"{WITH_OBS} " + _finding_sql("split_suspected", "'Track ' || track_id || ' may be part of a split mask'", "obs WHERE source = 'permissive'"))
def qc_split_suspected(spark, sf_dir):
    return quality.suspected(_suspects(spark, sf_dir), "split")


_ENDS = "e AS (SELECT track_id, min(frame) AS f0, max(frame) AS f1, arg_min(y_px, frame) AS y0, arg_max(y_px, frame) AS y1, (SELECT max(frame) FROM obs) AS last FROM obs GROUP BY track_id)"


@query(f"{WITH_OBS}, {_ENDS} " + _finding_sql("border_entry", "'Track ' || track_id || ' enters at the image border'", "e WHERE f0 > 0 AND y0 < 20", "f0") + " UNION ALL " + _finding_sql("border_exit", "'Track ' || track_id || ' leaves at the image border'", "e WHERE f1 < last AND y1 < 20", "f1"))
def qc_border_flags(spark, sf_dir):
    o = obs(spark, sf_dir)
    ends = o.groupBy("track_id").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.min_by("y_px", "frame").alias("y0"), F.max_by("y_px", "frame").alias("y1"))
    ends = ends.crossJoin(F.broadcast(o.agg(F.max("frame").alias("last"))))
    flagged = ends.withColumns({"enters": (F.col("first_frame") > 0) & (F.col("y0") < 20), "exits": (F.col("last_frame") < F.col("last")) & (F.col("y1") < 20)})
    return quality.border_flags(flagged)


@query(f"{WITH_OBS}, l AS (SELECT track_id, frame, (abs(x_c) % 50) / 10.0::DOUBLE AS margin, lag(frame) OVER (PARTITION BY track_id ORDER BY frame) AS before FROM obs) " + _finding_sql("link_ambiguous", "'Track ' || track_id || '''s link into frame ' || frame || ' is ambiguous'", "l WHERE before IS NOT NULL AND margin < 2.0"))
def qc_link_ambiguous(spark, sf_dir):
    return quality.link_ambiguous(quality.links(obs(spark, sf_dir).withColumn("link_margin", (F.abs("x_c") % 50) / F.lit(10.0))))


@query(f"""{WITH_OBS}, p AS (SELECT * FROM obs WHERE source = 'primary'), n AS (SELECT *, lead(frame) OVER w AS nf, lead(x_px) OVER w AS nx, lead(y_px) OVER w AS ny, lead(area_px) OVER w AS na FROM p WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
e AS (SELECT track_id, CAST(g AS INTEGER) AS frame, x_px + (nx - x_px) * (CAST(g - frame AS DOUBLE) / (nf - frame)) AS ex, y_px + (ny - y_px) * (CAST(g - frame AS DOUBLE) / (nf - frame)) AS ey, 0.5::DOUBLE * (area_px + na) AS ea FROM (SELECT *, unnest(generate_series(frame + 1, nf - 1)) AS g FROM n WHERE nf > frame + 1)),
c AS (SELECT e.track_id, e.frame, o.det_label AS label, CASE o.source WHEN 'window' THEN 1 ELSE 2 END AS tier, o.area_px AS oa, ea, sqrt((o.x_px - ex) * (o.x_px - ex) + (o.y_px - ey) * (o.y_px - ey)) AS offset_px FROM e JOIN obs o ON o.frame = e.frame AND o.source <> 'primary'),
k AS (SELECT *, row_number() OVER (PARTITION BY track_id, frame ORDER BY tier, offset_px, label) AS k FROM c WHERE offset_px <= 1.5::DOUBLE * greatest(sqrt(4 * ea), 30.0::DOUBLE) AND oa BETWEEN 0.25::DOUBLE * ea AND 4.0::DOUBLE * ea),
b AS (SELECT *, row_number() OVER (PARTITION BY frame, label ORDER BY tier, offset_px, track_id) = 1 AS won FROM k WHERE k = 1)
SELECT e.track_id, e.frame, coalesce(won, false) AS recovered, CASE WHEN won THEN CASE tier WHEN 1 THEN 'window' ELSE 'permissive' END END AS found_by, CASE WHEN won THEN label END AS label, CASE WHEN won THEN round(offset_px, 6) END AS offset_px, CASE WHEN label IS NULL THEN 'nothing plausible' WHEN won THEN '' ELSE 'taken by another track' END AS detail
FROM e LEFT JOIN b ON b.track_id = e.track_id AND b.frame = e.frame""")
def recovery_attempts(spark, sf_dir):
    o = obs(spark, sf_dir)
    return rounded(gates.recovery_attempts(o.where("source = 'primary'"), o.where("source <> 'primary'").withColumnRenamed("det_label", "label")))
