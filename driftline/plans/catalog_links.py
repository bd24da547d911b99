"""Queries of linking, regions and the operators that have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linking, regions, scoring, zlinking
from .catalog import SCALE, WITH_OBS, obs, query, r, rounded


def detections(spark, sf_dir):
    """Observations as detections of eight movies; a body is a box around its centre."""
    o = obs(spark, sf_dir)
    half = F.sqrt("area_px")
    return o.select(
        (F.col("track_id") % 8).alias("movie"), "frame", F.col("det_label").alias("label"), F.col("x_px").alias("x"), F.col("y_px").alias("y"), F.col("area_px").alias("area"), half.alias("minor"), (half * 1.5).alias("major"),
        (F.col("x_px") - half).alias("min_x"), (F.col("y_px") - half).alias("min_y"), (F.col("x_px") + half).alias("max_x"), (F.col("y_px") + half).alias("max_y"), (F.col("x_px") < half).alias("touches_border"),
    )


@query()
def link_tracks(spark, sf_dir):
    return linking.link_tracks(detections(spark, sf_dir), SCALE)


@query()
def link_events(spark, sf_dir):
    return linking.link_events(detections(spark, sf_dir), SCALE)


FRAME_SQL = f"{WITH_OBS}, d AS (SELECT track_id % 8 AS movie, frame FROM obs), g AS (SELECT movie AS m, CAST(unnest(generate_series(0, max(frame))) AS INTEGER) AS f FROM d GROUP BY movie) SELECT m AS movie, f AS frame, count(d.movie) AS detections FROM g LEFT JOIN d ON d.movie = m AND d.frame = f GROUP BY m, f"


@query(FRAME_SQL)
def link_event_frames(spark, sf_dir):
    """The linker's own account of every frame: matched and new tracks are all of its detections."""
    e = linking.link_events(detections(spark, sf_dir), SCALE)
    return e.select("movie", "frame", (F.col("matched") + F.col("new_tracks")).cast("bigint").alias("detections"))


@query(f"{WITH_OBS} SELECT track_id % 8 AS movie, frame, det_label AS label FROM obs")
def linked_detections(spark, sf_dir):
    """Every detection is in exactly one track."""
    return linking.link_tracks(detections(spark, sf_dir), SCALE, margins=False).select("movie", "frame", F.col("label"))


@query()
def overlap_link(spark, sf_dir):
    return zlinking.overlap_link(detections(spark, sf_dir))


def slices(spark, sf_dir):
    """Frames of a movie as slices of a stack."""
    d = detections(spark, sf_dir)
    return d.select(F.col("movie").alias("stack"), F.col("frame").alias("z"), "label", "x", "y", "area", F.lit(1.5).alias("shape"), "min_x", "min_y", "max_x", "max_y")


@query(f"""{WITH_OBS}, s AS (SELECT track_id % 8 AS stack, frame AS z, det_label AS label, x_px AS x, y_px AS y, area_px AS area, sqrt(area_px) AS h FROM obs),
p AS (SELECT a.stack, a.z, a.label AS a, b.label AS b, greatest(0, least(a.x + a.h, b.x + b.h) - greatest(a.x - a.h, b.x - b.h)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y - a.h, b.y - b.h)) AS i,
 ((a.x + a.h) - (a.x - a.h)) * ((a.y + a.h) - (a.y - a.h)) AS sa, ((b.x + b.h) - (b.x - b.h)) * ((b.y + b.h) - (b.y - b.h)) AS sb, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS dist, abs(ln(b.area / a.area)) AS la FROM s a JOIN s b ON a.stack = b.stack AND b.z = a.z + 1),
c AS (SELECT stack, z, a, b, 1 - coalesce(i / (sa + sb - i), 0) + dist / 15.0 + 0.5 * la AS cost FROM p)
SELECT stack, z, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, {r('cost')} FROM c WHERE cost <= 2.5""")
def z_pair_costs(spark, sf_dir):
    return rounded(zlinking.slice_pairs(slices(spark, sf_dir), 2.5))


@query()
def z_link(spark, sf_dir):
    return zlinking.link_slices(zlinking.slice_pairs(slices(spark, sf_dir)))


def pixels(spark, sf_dir):
    """Every observation drawn as a rectangle of pixels, later labels behind: label rows of a small movie."""
    o = obs(spark, sf_dir)
    rows = o.select("frame", F.col("det_label").alias("label"), F.col("x_px").cast("int").alias("x0"), F.col("y_px").cast("int").alias("y0"), (3 + F.col("track_id") % 5).cast("int").alias("w"), (3 + F.col("x_c") % 4).cast("int").alias("h"))
    px = rows.withColumn("x", F.explode(F.sequence(F.col("x0"), F.col("x0") + F.col("w") - 1))).withColumn("y", F.explode(F.sequence(F.col("y0"), F.col("y0") + F.col("h") - 1)))
    return px.groupBy("frame", "y", "x").agg(F.min("label").alias("label")).withColumn("value", ((F.col("x") * 7 + F.col("y") * 3 + F.col("frame")) % 50).cast("double"))


PIXEL_SQL = """b AS (SELECT frame, det_label AS label, CAST(trunc(x_px) AS INT) AS x0, CAST(trunc(y_px) AS INT) AS y0, CAST(3 + track_id % 5 AS INT) AS w, CAST(3 + x_c % 4 AS INT) AS h FROM obs),
px AS (SELECT frame, y, x, min(label) AS label, ((x * 7 + y * 3 + frame) % 50)::DOUBLE AS value FROM (SELECT frame, label, x, CAST(unnest(generate_series(y0, y0 + h - 1)) AS INT) AS y FROM (SELECT frame, label, y0, h, CAST(unnest(generate_series(x0, x0 + w - 1)) AS INT) AS x FROM b)) GROUP BY frame, y, x)"""


@query(f"""{WITH_OBS}, {PIXEL_SQL}, s AS (SELECT frame, label, count(*) AS area_px, min(x) AS min_x, min(y) AS min_y, max(x) + 1 AS max_x, max(y) + 1 AS max_y, avg(x) AS x, avg(y) AS y, var_pop(x) + 1.0::DOUBLE / 12 AS vx, var_pop(y) + 1.0::DOUBLE / 12 AS vy, covar_pop(x, y) AS c, avg(value) AS mean_intensity, median(value) AS median_intensity FROM px GROUP BY frame, label),
e AS (SELECT *, (vx + vy + sqrt((vx - vy) * (vx - vy) + 4 * c * c)) / 2 AS big, greatest(0, (vx + vy - sqrt((vx - vy) * (vx - vy) + 4 * c * c)) / 2) AS small FROM s)
SELECT frame, label, area_px, min_x, min_y, max_x, max_y, {r('x', 'y', 'mean_intensity', 'median_intensity')}, round(4 * sqrt(big), 5) AS major_axis_px, round(4 * sqrt(small), 5) AS minor_axis_px, round(sqrt(1 - small / big), 4) AS eccentricity, round(sqrt(4 * area_px / pi()), 6) AS equivalent_diameter_px, greatest(max_x - min_x, max_y - min_y) AS extent_px, round(area_px / ((max_x - min_x) * (max_y - min_y)), 6) AS extent_fraction FROM e""")
def region_metrics(spark, sf_dir):
    m = regions.region_metrics(pixels(spark, sf_dir)).drop("orientation_rad")
    m = m.withColumns({"major_axis_px": F.round("major_axis_px", 5), "minor_axis_px": F.round("minor_axis_px", 5), "eccentricity": F.round("eccentricity", 4)})
    return rounded(m, 6, "major_axis_px", "minor_axis_px", "eccentricity")


@query(f"{WITH_OBS}, {PIXEL_SQL}, s AS (SELECT frame, label, count(*) AS area_px, greatest(max(x) - min(x), max(y) - min(y)) + 1 AS extent_px FROM px GROUP BY frame, label) SELECT frame, count(*) AS raw, count(*) FILTER (WHERE extent_px >= 6) AS kept, count(*) FILTER (WHERE extent_px < 6) AS removed, max(extent_px) FILTER (WHERE extent_px < 6) AS removed_max_extent_px, max(area_px) FILTER (WHERE extent_px < 6) AS removed_max_area_px FROM s GROUP BY frame")
def filter_diagnostics(spark, sf_dir):
    return regions.filter_diagnostics(regions.region_metrics(pixels(spark, sf_dir)), 6)


@query(f"{WITH_OBS}, {PIXEL_SQL}, s AS (SELECT frame, label, count(*) AS area_px, greatest(max(x) - min(x), max(y) - min(y)) + 1 AS extent_px FROM px GROUP BY frame, label) SELECT frame, label, CAST(row_number() OVER (PARTITION BY frame ORDER BY label) AS INTEGER) AS new_label FROM s WHERE extent_px >= 6 AND area_px >= 12")
def instance_filter(spark, sf_dir):
    return regions.keep_instances(regions.region_metrics(pixels(spark, sf_dir)), 6, 12).select("frame", "label", "new_label")


@query(f"{WITH_OBS}, {PIXEL_SQL}, t AS (SELECT frame, y * 1000 + x AS pixel, label FROM px), p AS (SELECT frame, y * 1000 + x + 1 AS pixel, label FROM px) SELECT t.frame AS image, t.label AS truth_label, p.label AS pred_label, round(count(*) / (nt + np - count(*)), 6) AS iou FROM t JOIN p ON t.frame = p.frame AND t.pixel = p.pixel JOIN (SELECT frame, label, count(*) AS nt FROM t GROUP BY ALL) a ON a.frame = t.frame AND a.label = t.label JOIN (SELECT frame, label, count(*) AS np FROM p GROUP BY ALL) b ON b.frame = p.frame AND b.label = p.label GROUP BY t.frame, t.label, p.label, nt, np")
def pixel_overlap(spark, sf_dir):
    px = pixels(spark, sf_dir)
    truth = px.select(F.col("frame").alias("image"), (F.col("y") * 1000 + F.col("x")).alias("pixel"), "label")
    return rounded(scoring.pixel_overlap(truth, truth.withColumn("pixel", F.col("pixel") + 1)))


@query(f"{WITH_OBS}, {PIXEL_SQL}, c AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY y, x ORDER BY frame)) AS change, median(value) OVER (PARTITION BY y, x) AS mid FROM px) SELECT y, x, any_value(mid) AS median, avg(CASE WHEN label > 0 THEN 1.0 ELSE 0 END) AS persistence, max(change) AS max_change, round(1.4826::DOUBLE * median(abs(value - mid)), 6) AS sigma FROM c GROUP BY y, x")
def pixel_history(spark, sf_dir):
    return rounded(regions.pixel_history(pixels(spark, sf_dir)), 6)


@query(f"{WITH_OBS}, t AS (SELECT track_id, frame, x_px, y_px FROM obs), f AS (SELECT * FROM t WHERE (frame + track_id) % 4 > 0), h AS (SELECT t.track_id AS true_id, f.track_id, count(*) AS hits FROM t JOIN f ON t.frame = f.frame AND sqrt((t.x_px - f.x_px) * (t.x_px - f.x_px) + (t.y_px - f.y_px) * (t.y_px - f.y_px)) <= 5 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY true_id ORDER BY hits DESC, track_id) AS k FROM h), b AS (SELECT * FROM k WHERE k = 1) SELECT n.track_id AS true_id, b.track_id, coalesce(hits, 0) AS hits, round(coalesce(2 * hits / (n.n + m.n), 0), 6) AS f1 FROM (SELECT track_id, count(*) AS n FROM t GROUP BY 1) n LEFT JOIN b ON b.true_id = n.track_id LEFT JOIN (SELECT track_id, count(*) AS n FROM f GROUP BY 1) m ON m.track_id = b.track_id")
def identity_f1(spark, sf_dir):
    t = obs(spark, sf_dir).select("track_id", "frame", "x_px", "y_px")
    return rounded(scoring.identity_f1(t, t.where((F.col("frame") + F.col("track_id")) % 4 > 0), 5.0))


def bodies(spark, sf_dir):
    """Observations as rectangles of pixels of their track, growing and shrinking with its key."""
    o = obs(spark, sf_dir)
    # bodies drift by a pixel or two a frame, so they overlap from one to the next
    rows = o.select((F.col("track_id") % 6).alias("track_id"), "frame", (F.col("frame") + F.col("track_id") % 3).cast("int").alias("x0"), (F.col("y_px") % 3).cast("int").alias("y0"), (4 + F.col("x_c") % 4).cast("int").alias("w"), (3 + F.col("track_id") % 4).cast("int").alias("h"))
    px = rows.withColumn("x", F.explode(F.sequence(F.col("x0"), F.col("x0") + F.col("w") - 1))).withColumn("y", F.explode(F.sequence(F.col("y0"), F.col("y0") + F.col("h") - 1)))
    return px.select("track_id", "frame", "y", "x").distinct()


@query(f"""{WITH_OBS}, b AS (SELECT DISTINCT track_id % 6 AS track_id, frame, CAST(frame + track_id % 3 AS INT) AS x0, CAST(y_px AS INT) % 3 AS y0, CAST(4 + x_c % 4 AS INT) AS w, CAST(3 + track_id % 4 AS INT) AS h FROM obs),
px AS (SELECT DISTINCT track_id, frame, x, CAST(unnest(generate_series(y0, y0 + h - 1)) AS INT) AS y FROM (SELECT *, CAST(unnest(generate_series(x0, x0 + w - 1)) AS INT) AS x FROM b)),
c AS (SELECT track_id, frame, avg(x) AS cx, avg(y) AS cy FROM px GROUP BY ALL), m AS (SELECT a.track_id, a.frame, a.cx, a.cy, b.cx - a.cx AS mx, b.cy - a.cy AS my FROM c a JOIN c b ON a.track_id = b.track_id AND b.frame = a.frame + 1),
j AS (SELECT m.track_id, m.frame, coalesce(o.x, n.x) - cx AS px, coalesce(o.y, n.y) - cy AS py, mx, my, o.x IS NULL AS gained, n.x IS NULL AS lost FROM (SELECT * FROM px) o FULL JOIN (SELECT track_id, frame - 1 AS frame, x, y FROM px) n ON o.track_id = n.track_id AND o.frame = n.frame AND o.x = n.x AND o.y = n.y JOIN m ON m.track_id = coalesce(o.track_id, n.track_id) AND m.frame = coalesce(o.frame, n.frame)),
l AS (SELECT track_id, frame, gained, lost, CASE WHEN px * mx + py * my > abs(px * my - py * mx) THEN 'front' WHEN -(px * mx + py * my) > abs(px * my - py * mx) THEN 'rear' ELSE 'flank' END AS p FROM j)
SELECT track_id, frame, count(*) FILTER (WHERE NOT gained AND NOT lost) AS n_kept, """ + ", ".join(f"count(*) FILTER (WHERE {c} AND p = '{p}') AS {n}_{p}" for n, c in (("extension", "gained"), ("retraction", "lost")) for p in ("front", "rear", "flank")) + " FROM l GROUP BY track_id, frame")
def surface_delta(spark, sf_dir):
    from ..operators.surfaces import surface_delta as delta

    return delta(bodies(spark, sf_dir))
