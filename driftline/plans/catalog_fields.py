"""Queries of shapes and textures, partners, majorities, unions, rolling medians and overlaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fields, morphology
from .catalog import SCALE, WITH_OBS, obs, query, r, rounded
from .catalog_links import PIXEL_SQL, pixels
from .catalog_more import table

_NULLS = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in fields.MORPHOLOGY if c not in ("perimeter_px", "major_axis_px", "eccentricity"))


@query(f"{WITH_OBS} SELECT track_id, frame, {_NULLS}, round(area_px / 2, 6) AS perimeter_px, round(sqrt(area_px), 6) AS major_axis_px, CASE WHEN frame % 5 > 0 THEN round(1 / area_px, 6) END AS eccentricity, round(area_px / 2 * 0.5, 6) AS perimeter_um, round(sqrt(area_px) * 0.5, 6) AS major_axis_um, CAST(NULL AS DOUBLE) AS minor_axis_um, CAST(NULL AS DOUBLE) AS volume_um3 FROM obs")
def detection_morphology(spark, sf_dir):
    o = obs(spark, sf_dir)
    d = o.select("frame", F.col("det_label").alias("label"), (F.col("area_px") / 2).alias("perimeter_px"), F.sqrt("area_px").alias("major_axis_px"), F.when(F.col("frame") % 5 > 0, 1 / F.col("area_px")).otherwise(float("nan")).alias("eccentricity"))
    return rounded(fields.with_morphology(o.select("track_id", "frame", "det_label"), d, SCALE).drop("det_label"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Analysed' WHEN 1 THEN 'Failed' WHEN 2 THEN 'Stopped' ELSE 'queued' END AS status, coalesce(CASE WHEN doc_id % 3 > 0 THEN nullif(lang, '') END, source) AS shown, CASE WHEN doc_id % 2 = 0 THEN n_chars::DOUBLE ELSE doc_id * 60.0::DOUBLE END AS per_hr FROM documents")
def status_projection(spark, sf_dir):
    c, state = F.col, F.array(*map(F.lit, ("complete", "failed", "cancelled", "queued")))
    d = table(spark, sf_dir, "documents")
    shown = fields.first_present(F.when(c("doc_id") % 3 > 0, c("lang")).otherwise(""), c("source"))
    hourly = F.when(c("doc_id") % 2 == 0, c("n_chars").cast("double")).otherwise(float("nan"))
    return d.select("doc_id", fields.status_label(F.get(state, (c("doc_id") % 4).cast("int"))).alias("status"), shown.alias("shown"), fields.per_hour(hourly, c("doc_id").cast("double")).alias("per_hr"))


@query(f"""{WITH_OBS}, m AS (SELECT a.frame, a.det_label AS a, b.det_label AS b, sqrt((b.x_px - a.x_px) * (b.x_px - a.x_px) + (b.y_px - a.y_px) * (b.y_px - a.y_px)) AS distance_px FROM obs a JOIN obs b ON b.frame = a.frame + 1),
n AS (SELECT *, count(*) OVER (PARTITION BY frame, a) AS na, count(*) OVER (PARTITION BY frame, b) AS nb FROM m WHERE distance_px <= 9)
SELECT frame, a, b, {r('distance_px')} FROM n WHERE na = 1 AND nb = 1""")
def radius_partners(spark, sf_dir):
    o = obs(spark, sf_dir)
    side = lambda step: o.select((F.col("frame") - step).alias("frame"), F.col("det_label").alias("key"), F.col("x_px").alias("x"), F.col("y_px").alias("y"))
    return rounded(fields.radius_partners(side(0), side(1), "frame", 9.0))


@query(f"{WITH_OBS}, c AS (SELECT track_id, x_c % 5 - 1 AS channel, count(*) AS n FROM obs WHERE x_c % 5 >= 1 GROUP BY ALL) SELECT track_id, channel FROM c QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY n DESC, channel) = 1")
def channel_majority(spark, sf_dir):
    return fields.majority(obs(spark, sf_dir).select("track_id", (F.col("x_c") % 5 - 1).alias("channel")), "track_id", "channel", F.col("channel") >= 0)


@query(f"{WITH_OBS} SELECT track_id, frame, area_px, CAST(NULL AS VARCHAR) AS found_by FROM obs WHERE source = 'primary' UNION ALL SELECT track_id, frame, CAST(NULL AS DOUBLE), source FROM obs WHERE source <> 'primary'")
def column_union(spark, sf_dir):
    o = obs(spark, sf_dir)
    return fields.united([o.where("source = 'primary'").select("track_id", "frame", "area_px"), o.where("source <> 'primary'").select("track_id", "frame", F.col("source").alias("found_by"))])


@query(f"""{WITH_OBS}, w AS (SELECT track_id, frame, row_number() OVER t AS k, count(*) OVER (PARTITION BY track_id) AS n, array_agg(x_px) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS l,
 first_value(x_px) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f, last_value(x_px) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS e FROM obs WINDOW t AS (PARTITION BY track_id ORDER BY frame))
SELECT track_id, frame, list_sort(list_concat(l, list_concat(list_transform(range(greatest(3 - k, 0)), lambda i: f), list_transform(range(greatest(2 - (n - k), 0)), lambda i: e))))[3] AS rolling_median FROM w""")
def rolling_median(spark, sf_dir):
    return fields.rolling_median(obs(spark, sf_dir).select("track_id", "frame", "x_px"), "track_id", "frame", "x_px", 5).drop("x_px")


_MU = ", ".join(f"sum(pow(u, {p}) * pow(v, {q})) / pow(count(*), {1 + (p + q) / 2}) AS n{p}{q}" for p, q in ((2, 0), (1, 1), (0, 2), (3, 0), (2, 1), (1, 2), (0, 3)))


def _log(value: str) -> str:
    return f"round(CASE WHEN {value} <= -1e-12 THEN 1 ELSE -1 END * log10(greatest(abs({value}), 1e-12)), 4)"


@query(f"""{WITH_OBS}, {PIXEL_SQL}, c AS (SELECT frame, label, (x - avg(x) OVER o)::DOUBLE AS u, (y - avg(y) OVER o)::DOUBLE AS v FROM px WINDOW o AS (PARTITION BY frame, label)), m AS (SELECT frame, label, {_MU} FROM c GROUP BY frame, label),
s AS (SELECT *, n30 + n12 AS a, n21 + n03 AS b, n30 - 3 * n12 AS c, 3 * n21 - n03 AS d, n20 - n02 AS e FROM m)
SELECT frame, label, {_log('(n20 + n02)')} AS hu1, {_log('(e * e + 4 * n11 * n11)')} AS hu2, {_log('(c * c + d * d)')} AS hu3, {_log('(a * a + b * b)')} AS hu4 FROM s""")
def hu_invariants(spark, sf_dir):
    out = morphology.hu_invariants(pixels(spark, sf_dir))
    return rounded(out.select("frame", "label", *[f"hu{i}" for i in range(1, 5)]), 4)


@query(f"""{WITH_OBS}, {PIXEL_SQL}, s AS (SELECT frame, label, y, x, unnest([-1, 1, 0, 0]) AS dy, unnest([0, 0, -1, 1]) AS dx FROM px), f AS (SELECT s.frame, s.label, s.y, s.x, count(*) AS n FROM s LEFT JOIN px q ON q.frame = s.frame AND q.label = s.label AND q.y = s.y + dy AND q.x = s.x + dx WHERE q.frame IS NULL GROUP BY ALL)
SELECT frame, label, CAST(sum(n) AS BIGINT) AS sides, count(*) AS edge_pixels FROM f GROUP BY frame, label""")
def object_outline(spark, sf_dir):
    return morphology.outline(pixels(spark, sf_dir))


@query(f"""{WITH_OBS}, {PIXEL_SQL}, e AS (SELECT frame, label, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM px GROUP BY frame, label),
g AS (SELECT frame, label, y, x, CASE WHEN hi > lo THEN CAST(greatest(0, least(15, floor(round((value - lo) / (hi - lo) * 16, 9)))) AS INTEGER) ELSE 0 END AS g FROM px JOIN e USING (frame, label)),
s AS (SELECT frame, label, y, x, g, unnest([0, 1, 2, 3]) AS way, unnest([0, 1, 1, 1]) AS dy, unnest([1, 0, 1, -1]) AS dx FROM g),
o AS (SELECT s.frame, s.label, way, s.g AS a, q.g AS b FROM s JOIN g q ON q.frame = s.frame AND q.label = s.label AND q.y = s.y + dy AND q.x = s.x + dx),
n AS (SELECT frame, label, way, a, b, count(*)::DOUBLE AS n FROM (SELECT * FROM o UNION ALL SELECT frame, label, way, b, a FROM o) GROUP BY ALL),
w AS (SELECT frame, label, way, sum(n) AS t, sum(n * (a - b) * (a - b)) AS c, sum(n / (1 + (a - b) * (a - b))) AS h, sum(n * n) AS e, sum(n * a) / sum(n) AS m, sum(n * a * a) / sum(n) AS maa, sum(n * a * b) / sum(n) AS mab FROM n GROUP BY ALL)
SELECT frame, label, round(avg(c / t), 6) AS glcm_contrast, round(avg(h / t), 6) AS glcm_homogeneity, round(avg(sqrt(e) / t), 6) AS glcm_energy, round(avg(CASE WHEN maa - m * m > 1e-12 THEN (mab - m * m) / (maa - m * m) ELSE 1 END), 5) AS glcm_correlation FROM w GROUP BY frame, label""")
def object_texture(spark, sf_dir):
    out = morphology.texture(pixels(spark, sf_dir))
    return rounded(out.withColumn("glcm_correlation", F.round("glcm_correlation", 5)), 6, "glcm_correlation")


@query()
def object_hulls(spark, sf_dir):
    return rounded(morphology.hulls(pixels(spark, sf_dir)))


_MOVIES = "f AS (SELECT track_id % 6 AS movie, track_id % 2 AS acquisition, CASE WHEN track_id % 6 <> 4 THEN frame END AS source_frame, CASE WHEN track_id % 6 <> 5 THEN md5(CAST(CASE WHEN track_id % 6 IN (0, 2) THEN frame ELSE count(*) END AS VARCHAR)) END AS content FROM obs GROUP BY track_id % 6, track_id % 2, frame)"


@query(f"""{WITH_OBS}, {_MOVIES}, m AS (SELECT movie, acquisition, count(content) AS images, count(source_frame) AS numbered FROM f GROUP BY ALL),
s AS (SELECT p.movie AS a, q.movie AS b, p.content = q.content AS same, row_number() OVER (PARTITION BY p.movie, q.movie ORDER BY p.source_frame) AS k, count(*) OVER (PARTITION BY p.movie, q.movie) AS n FROM f p JOIN f q ON p.acquisition = q.acquisition AND p.source_frame = q.source_frame AND p.movie < q.movie WHERE p.content IS NOT NULL AND q.content IS NOT NULL),
c AS (SELECT a, b, any_value(n) AS shared_frames, count(*) AS checked_frames, bool_and(same) AS same FROM s WHERE k IN (1, n, n // 2 + 1) GROUP BY a, b)
SELECT p.movie AS a, q.movie AS b, coalesce(shared_frames, 0) AS shared_frames, coalesce(checked_frames, 0) AS checked_frames, CASE WHEN least(p.images, q.images) = 0 THEN 'not checked: no image' WHEN least(p.numbered, q.numbered) = 0 THEN 'not checked: no source frame numbers' WHEN same IS NULL THEN 'undecidable: no shared instant' WHEN same THEN 'same pixels' ELSE 'different regions' END AS verdict
FROM m p JOIN m q ON p.acquisition = q.acquisition AND p.movie < q.movie LEFT JOIN c ON c.a = p.movie AND c.b = q.movie""")
def movie_overlaps(spark, sf_dir):
    movie = F.col("track_id") % 6
    f = obs(spark, sf_dir).groupBy(movie.alias("movie"), (F.col("track_id") % 2).alias("acquisition"), "frame").agg(F.count("*").alias("n"))
    content = F.md5(F.when(F.col("movie").isin(0, 2), F.col("frame")).otherwise(F.col("n")).cast("string"))
    return fields.overlap_evidence(f.select("movie", "acquisition", F.when(F.col("movie") != 4, F.col("frame")).alias("source_frame"), F.when(F.col("movie") != 5, content).alias("content")))
