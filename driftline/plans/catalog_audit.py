"""Queries of audits and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calibration
from ..operators import audit, gaps
from .catalog import SCALE, WITH_OBS, obs, query, rounded


@query(f"{WITH_OBS}, c AS (SELECT a.track_id, a.frame, o AS \"offset\", b.det_label AS label, sqrt((b.x_px - a.x_px) * (b.x_px - a.x_px) + (b.y_px - a.y_px) * (b.y_px - a.y_px)) AS distance_px FROM (SELECT *, unnest([-2, -1, 1, 2]) AS o FROM obs) a JOIN obs b ON b.frame = a.frame + o), k AS (SELECT *, row_number() OVER (PARTITION BY track_id, frame, \"offset\" ORDER BY distance_px, label) AS k FROM c) SELECT track_id, frame, \"offset\", label, round(distance_px, 6) AS distance_px FROM k WHERE k = 1")
def temporal_candidates(spark, sf_dir):
    return rounded(audit.temporal_candidates(obs(spark, sf_dir)))


@query(f"{WITH_OBS}, w AS (SELECT CASE WHEN lag(frame) OVER t IS NULL THEN 'no_history' WHEN lead(frame) OVER t IS NULL THEN 'track_end' WHEN lead(frame) OVER t > frame + 6 THEN 'not_seen_at_horizon' WHEN source <> 'primary' THEN 'borrowed' ELSE 'used' END AS why FROM obs WINDOW t AS (PARTITION BY track_id ORDER BY frame)) SELECT " + ", ".join(f"count(*) FILTER (WHERE why = '{k}') AS n_{k}" for k in ("used", "no_history", "track_end", "not_seen_at_horizon", "borrowed")) + ", count(*) AS n_rows FROM w")
def sample_exclusions(spark, sf_dir):
    return audit.exclusions(obs(spark, sf_dir), 6)


_SPEED = "SELECT {k}track_id, avg(speed) AS mean, arg_max(net, frame) AS net FROM (SELECT *, sqrt((x_px - lag(x_px) OVER w) * (x_px - lag(x_px) OVER w) + (y_px - lag(y_px) OVER w) * (y_px - lag(y_px) OVER w)) * 0.5::DOUBLE / ((frame - lag(frame) OVER w) * 60.0::DOUBLE) AS speed, sqrt((x_px - first_value(x_px) OVER w) * (x_px - first_value(x_px) OVER w) + (y_px - first_value(y_px) OVER w) * (y_px - first_value(y_px) OVER w)) * 0.5::DOUBLE / nullif((frame - first_value(frame) OVER w) * 60.0::DOUBLE, 0) AS net FROM {t} WINDOW w AS (PARTITION BY {k}track_id ORDER BY frame)) GROUP BY {k}track_id"


@query(f"{WITH_OBS}, c AS (SELECT * FROM (SELECT *, unnest([0.05, 0.15, 0.3]::DOUBLE[]) AS rate FROM (SELECT *, unnest([0, 1, 2]) AS trial FROM obs)) WHERE CAST('0x' || md5(track_id || ':' || frame || ':' || trial)[1:8] AS BIGINT) / 4294967296.0::DOUBLE >= rate), a AS ({_SPEED.format(k='', t='obs')}), b AS ({_SPEED.format(k='rate, trial, ', t='c')}), e AS (SELECT rate, b.mean, abs(b.mean / nullif(a.mean, 0) - 1) * 100 AS em, abs(b.net / nullif(a.net, 0) - 1) * 100 AS en FROM b JOIN a USING (track_id)) SELECT rate, count(*) AS n, round(quantile_cont(em, 0.5), 5) AS mean_median, round(quantile_cont(em, 0.9), 5) AS mean_p90, round(quantile_cont(en, 0.5), 5) AS net_median, round(quantile_cont(en, 0.9), 5) AS net_p90, avg(CASE WHEN mean IS NULL THEN 1.0 ELSE 0 END) AS broken FROM e GROUP BY rate")
def loss_robustness(spark, sf_dir):
    return rounded(audit.loss_robustness(obs(spark, sf_dir), SCALE), 5, "rate", "broken")


@query(f"{WITH_OBS}, h AS (SELECT a.track_id AS a_track, b.track_id AS b_track, count(*) AS hits FROM obs a JOIN obs b ON a.frame = b.frame AND a.source <> 'window' AND b.source <> 'permissive' AND sqrt((b.x_px - a.x_px) * (b.x_px - a.x_px) + (b.y_px - a.y_px) * (b.y_px - a.y_px)) <= 5 GROUP BY 1, 2) SELECT a_track, b_track, round(hits / n, 6) AS share FROM h JOIN (SELECT track_id, count(*) AS n FROM obs WHERE source <> 'window' GROUP BY 1) s ON s.track_id = a_track WHERE hits / n >= 0.5")
def duplicate_tracks(spark, sf_dir):
    o = obs(spark, sf_dir)
    return rounded(audit.duplicate_tracks(o.where("source <> 'window'"), o.where("source <> 'permissive'")))


@query(f"{WITH_OBS}, t AS (SELECT frame, max(det_label) AS top FROM obs WHERE source = 'primary' GROUP BY frame) SELECT r.frame, track_id AS key, CAST(coalesce(top, 0) + row_number() OVER (PARTITION BY r.frame ORDER BY track_id) AS INTEGER) AS label FROM (SELECT * FROM obs WHERE source <> 'primary') r LEFT JOIN t ON t.frame = r.frame")
def recovered_labels(spark, sf_dir):
    o = obs(spark, sf_dir)
    return audit.recovered_labels(o.where("source = 'primary'"), o.where("source <> 'primary'").select("frame", F.col("track_id").alias("key")))


@query(f"{WITH_OBS}, n AS (SELECT *, lead(frame) OVER w AS nf, lead(det_label) OVER w AS nl FROM obs WINDOW w AS (PARTITION BY track_id ORDER BY frame)), m AS (SELECT track_id AS attempt, CAST(unnest(generate_series(frame + 1, nf - 1)) AS INTEGER) AS frame, CAST(999 AS INTEGER) AS label, frame AS bf, det_label AS bl, nf AS af, nl AS al FROM n WHERE nf > frame + 1), k AS (SELECT * FROM obs WHERE source = 'primary') SELECT m.attempt, m.frame, coalesce(a.track_id, b.track_id, c.track_id) AS track_id, CASE WHEN coalesce(a.track_id, b.track_id, c.track_id) IS NULL THEN 'no track holds it or its bracket' ELSE '' END AS note FROM m LEFT JOIN k a ON a.frame = m.frame AND a.det_label = m.label LEFT JOIN k b ON b.frame = bf AND b.det_label = bl LEFT JOIN k c ON c.frame = af AND c.det_label = al")
def recovery_attribution(spark, sf_dir):
    o = obs(spark, sf_dir)
    attempts = gaps.expected_positions(o).select(F.col("track_id").alias("attempt"), "frame", F.lit(999).alias("label"), "before_frame", "before_label", "after_frame", "after_label")
    return audit.attribute_recovery(attempts, o.where("source = 'primary'")).select("attempt", "frame", "track_id", "note")


@query(f"{WITH_OBS} SELECT count(*) AS n_detections, count(*) FILTER (WHERE source = 'primary') AS n_primary, count(*) FILTER (WHERE source = 'window') AS n_window, count(*) FILTER (WHERE source = 'permissive') AS n_permissive, count(DISTINCT track_id) AS n_tracks, (SELECT count(*) FROM (SELECT track_id FROM obs GROUP BY track_id HAVING count(*) >= 2)) AS n_tracks_with_speed, count(DISTINCT frame) AS n_frames FROM obs")
def manifest_counts(spark, sf_dir):
    return audit.manifest_counts(obs(spark, sf_dir))


@query(f"{WITH_OBS}, c AS (SELECT track_id, frame, CASE WHEN frame % 7 = 0 THEN x_px END AS u, CASE WHEN frame % 3 = 0 THEN y_px - 50 END AS f, CASE WHEN frame % 2 = 0 THEN area_px END AS d, 1.5::DOUBLE AS t FROM obs) SELECT track_id, frame, CASE WHEN u > 0 THEN u WHEN f > 0 THEN f WHEN d > 0 THEN d ELSE t END AS value, CASE WHEN u > 0 THEN 'user' WHEN f > 0 THEN 'file' WHEN d > 0 THEN 'document' ELSE 'tag' END AS source FROM c")
def pixel_size_source(spark, sf_dir):
    c = F.col
    size = calibration.pixel_size(F.when(c("frame") % 7 == 0, c("x_px")), F.when(c("frame") % 3 == 0, c("y_px") - 50), F.when(c("frame") % 2 == 0, c("area_px")), F.lit(1.5))
    return obs(spark, sf_dir).select("track_id", "frame", size.alias("s")).select("track_id", "frame", "s.value", "s.source")


@query(f"{WITH_OBS} SELECT track_id, frame, y_px AS y, x_px AS x FROM obs")
def track_layer(spark, sf_dir):
    return audit.track_layer(obs(spark, sf_dir))


@query(f"""{WITH_OBS.replace('WITH', 'WITH RECURSIVE', 1)}, l AS (SELECT track_id, list(frame ORDER BY x_px DESC, frame) AS frames FROM obs GROUP BY track_id),
k(track_id, i, kept) AS (SELECT track_id, 0, []::INTEGER[] FROM l UNION ALL SELECT l.track_id, i + 1, CASE WHEN len(list_filter(kept, lambda f: abs(f - frames[i + 1]) < 24)) = 0 THEN list_append(kept, frames[i + 1]) ELSE kept END FROM k JOIN l ON l.track_id = k.track_id AND i < len(frames)),
u AS (SELECT k.track_id, unnest(kept) AS frame FROM k JOIN l ON l.track_id = k.track_id AND i = len(frames))
SELECT track_id, frame, x_px FROM u JOIN obs USING (track_id, frame)""")
def score_peaks(spark, sf_dir):
    return audit.peaks(obs(spark, sf_dir).select("track_id", "frame", "x_px"), "track_id", "frame", "x_px", 24.0)
