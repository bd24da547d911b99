"""Queries of gates, differences, recovery, tubes, models and synthetic data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import gates, imaging, inference, lanes, models
from ..operators.similarity import top_by
from .catalog import SCALE, SETTINGS, WITH_OBS, obs, query, r, rounded
from .catalog_more import LABELLED, LANE_SQL, LANES, scored_docs, table


@query(f"{WITH_OBS}, s AS (SELECT track_id, frame, frame - lag(frame) OVER w AS dt, sqrt((x_px - lag(x_px) OVER w) * (x_px - lag(x_px) OVER w) + (y_px - lag(y_px) OVER w) * (y_px - lag(y_px) OVER w)) AS st, area_px, lag(area_px) OVER w AS a0, {LANE_SQL} AS l1, lag({LANE_SQL}) OVER w AS l0 FROM obs WINDOW w AS (PARTITION BY track_id ORDER BY frame)) SELECT track_id, frame, dt, CASE WHEN dt < 1 OR dt > 4 THEN 'gap_too_long' WHEN l0 >= 0 AND l1 >= 0 AND l0 <> l1 THEN 'lane' WHEN st * 0.5 / (dt * 60.0) > 5.0 THEN 'speed' WHEN area_px / greatest(a0, 1.0) < 0.3 OR area_px / greatest(a0, 1.0) > 3.0 THEN 'size' END AS refused_because FROM s WHERE dt IS NOT NULL")
def gate_reasons(spark, sf_dir):
    return gates.gated_steps(lanes.with_lane(obs(spark, sf_dir), LANES), SCALE, SETTINGS)


@query(f"{WITH_OBS}, a AS (SELECT frame AS from_frame, det_label AS from_label, lead(frame) OVER w AS to_frame, lead(det_label) OVER w AS to_label FROM obs WINDOW w AS (PARTITION BY track_id ORDER BY frame)), b AS (SELECT frame AS from_frame, det_label AS from_label, lead(frame) OVER w AS to_frame, lead(det_label) OVER w AS to_label FROM obs WHERE source <> 'window' WINDOW w AS (PARTITION BY track_id ORDER BY frame)) SELECT *, 'a' AS only_in FROM (SELECT * FROM a WHERE to_frame IS NOT NULL EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b WHERE to_frame IS NOT NULL EXCEPT SELECT * FROM a)")
def link_difference(spark, sf_dir):
    o = obs(spark, sf_dir)
    return gates.link_difference(gates.links_of(o), gates.links_of(o.where("source <> 'window'")))


@query(f"""{WITH_OBS}, p AS (SELECT * FROM obs WHERE source = 'primary'), n AS (SELECT *, lead(frame) OVER w AS nf, lead(x_px) OVER w AS nx, lead(y_px) OVER w AS ny, lead(area_px) OVER w AS na FROM p WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
e AS (SELECT track_id, CAST(g AS INTEGER) AS frame, x_px + (nx - x_px) * (CAST(g - frame AS DOUBLE) / (nf - frame)) AS ex, y_px + (ny - y_px) * (CAST(g - frame AS DOUBLE) / (nf - frame)) AS ey, 0.5::DOUBLE * (area_px + na) AS ea FROM (SELECT *, unnest(generate_series(frame + 1, nf - 1)) AS g FROM n WHERE nf > frame + 1)),
c AS (SELECT e.track_id, e.frame, o.det_label AS label, o.area_px AS oa, ea, sqrt((o.x_px - ex) * (o.x_px - ex) + (o.y_px - ey) * (o.y_px - ey)) AS offset_px FROM e JOIN obs o ON o.frame = e.frame AND o.source <> 'primary'),
k AS (SELECT *, row_number() OVER (PARTITION BY track_id, frame ORDER BY offset_px, label) AS k FROM c WHERE offset_px <= 1.5::DOUBLE * greatest(sqrt(4 * ea), 30.0::DOUBLE) AND oa BETWEEN 0.25::DOUBLE * ea AND 4.0::DOUBLE * ea)
SELECT track_id, frame, label, round(offset_px, 6) AS offset_px FROM k WHERE k = 1""")
def recovery_candidates(spark, sf_dir):
    o = obs(spark, sf_dir)
    return rounded(gates.recovery_candidates(o.where("source = 'primary'"), o.where("source <> 'primary'").withColumnRenamed("det_label", "label")))


@query(f"""{WITH_OBS}, v AS (SELECT track_id, frame, (frame - lag(frame) OVER w) * 60.0::DOUBLE AS dt, (frame - first_value(frame) OVER w) * 60.0::DOUBLE AS elapsed_min, (x_px - lag(x_px) OVER w) * 0.5::DOUBLE / ((frame - lag(frame) OVER w) * 60.0::DOUBLE) AS vx, (y_px - lag(y_px) OVER w) * 0.5::DOUBLE / ((frame - lag(frame) OVER w) * 60.0::DOUBLE) AS vy, (area_px - lag(area_px) OVER w) * 0.25::DOUBLE / ((frame - lag(frame) OVER w) * 60.0::DOUBLE) AS da_dt FROM obs WINDOW w AS (PARTITION BY track_id ORDER BY frame))
SELECT track_id, frame, elapsed_min, round(vx + 1.7320508e-10, 8) AS vx, round(vy + 1.7320508e-10, 8) AS vy, round(da_dt + 1.7320508e-10, 8) AS da_dt, round((vx - lag(vx) OVER w) / dt + 1.7320508e-12, 10) AS ax, round((vy - lag(vy) OVER w) / dt + 1.7320508e-12, 10) AS ay, round((da_dt - lag(da_dt) OVER w) / dt + 1.7320508e-12, 10) AS d2a_dt2 FROM v WINDOW w AS (PARTITION BY track_id ORDER BY frame)""")
def tube_rates(spark, sf_dir):
    t = gates.tube_rates(obs(spark, sf_dir), SCALE)
    # whole pixels over whole hours end in a 5 often: a step off the tie keeps two engines' last bits from deciding
    eight, ten = ("vx", "vy", "da_dt"), ("ax", "ay", "d2a_dt2")
    return t.select("track_id", "frame", "elapsed_min", *[F.round(F.col(c) + 1.7320508e-10, 8).alias(c) for c in eight], *[F.round(F.col(c) + 1.7320508e-12, 10).alias(c) for c in ten])


@query("""WITH r AS (SELECT o_orderkey, o_orderpriority AS fold, sum(l_quantity)::DOUBLE AS quantity, count(*)::DOUBLE AS lines, any_value(o_totalprice)::DOUBLE AS y FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority),
g AS (SELECT fold, count(*)::DOUBLE AS n, sum(quantity) AS q, sum(lines) AS l, sum(y) AS y, sum(quantity * quantity) AS qq, sum(lines * lines) AS ll, sum(quantity * lines) AS ql, sum(quantity * y) AS qy, sum(lines * y) AS ly FROM r GROUP BY fold),
t AS (SELECT fold, t.n - g.n AS n, t.q - g.q AS q, t.l - g.l AS l, t.y - g.y AS y, t.qq - g.qq AS qq, t.ll - g.ll AS ll, t.ql - g.ql AS ql, t.qy - g.qy AS qy, t.ly - g.ly AS ly FROM g, (SELECT sum(n) AS n, sum(q) AS q, sum(l) AS l, sum(y) AS y, sum(qq) AS qq, sum(ll) AS ll, sum(ql) AS ql, sum(qy) AS qy, sum(ly) AS ly FROM g) t),
m AS (SELECT fold, n, q / n AS mq, l / n AS ml, y / n AS my, sqrt(qq / n - (q / n) * (q / n)) AS sq, sqrt(ll / n - (l / n) * (l / n)) AS sl, ql / n - (q / n) * (l / n) AS cql, qy / n - (q / n) * (y / n) AS cqy, ly / n - (l / n) * (y / n) AS cly FROM t),
w AS (SELECT *, 1 + 1 / n AS a, cql / (sq * sl) AS c, cqy / sq AS b1, cly / sl AS b2 FROM m),
s AS (SELECT *, (a * b1 - c * b2) / (a * a - c * c) / sq AS wq, (a * b2 - c * b1) / (a * a - c * c) / sl AS wl FROM w)
SELECT o_orderkey, r.fold, quantity, lines, r.y, round(wq * quantity + wl * lines + my - mq * wq - ml * wl, 2) AS pred FROM r JOIN s ON s.fold = r.fold""")
def ridge_predictions(spark, sf_dir):
    """Prices of orders predicted for each priority from all others."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").cast("double").alias("quantity"), F.count("*").alias("lines")), "o_orderkey")
    rows = o.select("o_orderkey", F.col("o_orderpriority").alias("fold"), "quantity", F.col("lines").cast("double").alias("lines"), F.col("o_totalprice").cast("double").alias("y"))
    return models.leave_one_group_out(rows, "fold", ["quantity", "lines"], "y").withColumn("pred", F.round("pred", 2))


@query("SELECT round(regr_slope(p, q), 4) AS weight, round(regr_intercept(p, q), 2) AS intercept FROM (SELECT sum(l_quantity)::DOUBLE AS q, any_value(o_totalprice)::DOUBLE AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)")
def least_squares(spark, sf_dir):
    """A ridge without a penalty is a least-squares line."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").cast("double").alias("q")), "o_orderkey").select("q", F.col("o_totalprice").cast("double").alias("p"))
    m = models.ridge(rows, ["q"], "p", 0.0)
    return spark.createDataFrame([(round(m.weights[0], 4), round(m.intercept, 2))], "weight double, intercept double")


def _newton(steps: int = 8) -> str:
    """Newton's steps of a logistic model of one feature, each from the sums at the one before."""
    out = ["p0 AS (SELECT 0.0::DOUBLE AS b, 0.0::DOUBLE AS c)"]
    for k in range(steps):
        sums = f"SELECT any_value(b) AS b, any_value(c) AS c, sum(p * (1 - p) * size * size) + 1 + 1e-9 AS h11, sum(p * (1 - p) * size) AS h12, sum(p * (1 - p)) + 1e-9 AS h22, sum((y - p) * size) - any_value(b) AS g1, sum(y - p) AS g2 FROM (SELECT *, 1 / (1 + exp(-(b * size + c))) AS p FROM x, p{k})"
        out.append(f"p{k + 1} AS (SELECT b + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12) AS b, c + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) AS c FROM ({sums}))")
    return ", ".join(out)


@query(f"WITH {LABELLED}, x AS (SELECT doc_id, ln(1 + n_chars) AS size, (quality = 1)::INT::DOUBLE AS y FROM d), {_newton()} SELECT doc_id, round(size, 9) AS size, y, round(1 / (1 + exp(-(b * size + c))), 6) AS p FROM x, p8")
def logistic_probabilities(spark, sf_dir):
    rows = scored_docs(spark, sf_dir).select("doc_id", F.log1p("n_chars").alias("size"), F.col("truth").cast("double").alias("y"))
    return rows.withColumn("p", F.round(models.logistic(rows, ["size"], "y").probability(), 6)).withColumn("size", F.round("size", 9))


_TIMES = " + ".join(f"(u >= {t!r})::INT" for t in inference.poisson_steps())


@query(f"""{WITH_OBS}, per AS (SELECT track_id, sum(x_px) AS s, count(x_px) AS n FROM obs GROUP BY track_id), d AS (SELECT *, CAST('0x' || md5('0:' || k || ':' || track_id)[1:8] AS BIGINT) / 4294967296.0::DOUBLE AS u FROM per, (SELECT unnest(generate_series(0, 199)) AS k)),
m AS (SELECT k, sum(s * ({_TIMES})) / nullif(sum(n * ({_TIMES})), 0) AS mean FROM d GROUP BY k)
SELECT round(estimate, 6) AS estimate, n_units, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM (SELECT sum(s) / sum(n) AS estimate, count(*) AS n_units FROM per), (SELECT quantile_cont(mean, 0.025) AS ci_low, quantile_cont(mean, 0.975) AS ci_high FROM m)""")
def bootstrap_interval(spark, sf_dir):
    return rounded(inference.track_bootstrap(obs(spark, sf_dir).select("track_id", F.col("x_px").alias("value"))))


@query()
def recall_intervals(spark, sf_dir):
    s = scored_docs(spark, sf_dir).groupBy("lang").agg(F.count_if(F.col("truth") & F.col("predicted")).alias("hits"), F.count_if("truth").alias("n"))
    return s.withColumn("interval", stats.interval_columns(F.col("hits"), F.col("n"))).select("lang", "hits", "n", "interval.low", "interval.high")


@query("SELECT source, CAST(row_number() OVER (ORDER BY sum(n_chars) DESC, source) AS INTEGER) AS place, CAST(sum(n_chars) AS BIGINT) AS n FROM documents GROUP BY source QUALIFY place <= 8")
def top_sources(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("n")).withColumn("one", F.lit(1))
    return top_by(rows, "one", [F.desc("n"), F.col("source")], 8).select("source", "place", "n")


@query("""WITH RECURSIVE s AS (SELECT source AS g, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS i FROM documents GROUP BY source),
f(i, g, fold, loads) AS (SELECT 0::BIGINT, NULL::VARCHAR, NULL::INT, [0, 0, 0, 0]::BIGINT[] UNION ALL SELECT s.i, s.g, list_position(loads, list_min(loads)) - 1, list_transform(loads, lambda x, k: CASE WHEN k = list_position(loads, list_min(loads)) THEN x + s.n ELSE x END) FROM f JOIN s ON s.i = f.i + 1)
SELECT g AS "group", CAST(fold AS INTEGER) AS fold FROM f WHERE i > 0""")
def group_folds(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("group")).agg(F.count("*").alias("n"))
    return inference.group_folds(sizes, 4)


@query("SELECT CAST(m AS BIGINT) AS movie, CAST(t AS BIGINT) AS track_id, count(*) AS n FROM (SELECT unnest(generate_series(0, 4)) AS m), (SELECT unnest(generate_series(0, 5)) AS t), (SELECT unnest(generate_series(0, 13)) AS f) GROUP BY m, t")
def synthetic_movies(spark, sf_dir):
    return models.synthetic_tracks(spark).groupBy("movie", "track_id").agg(F.count("*").alias("n"))


@query()
def registration(spark, sf_dir):
    """Vectors as small images (8 by 8), one movie per label."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("movie"), F.col("vec_id").cast("int").alias("frame"), "embedding")

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"movie": pdf["movie"], "frame": pdf["frame"], "height": 8, "width": 8, "pixels": [np.asarray(v, np.float32).tobytes() for v in pdf["embedding"]]})

    return imaging.register(rows.mapInPandas(run, "movie bigint, frame int, height int, width int, pixels binary"))
