"""Scores of predictions against truth: counts to precision, recall and F1, breakdowns, matching by overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0)))


def prf(rows: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn of ``rows`` (truth, predicted: booleans) with precision, recall and f1, per group of ``by``."""
    t, p = F.col("truth"), F.col("predicted")
    sums = rows.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def pooled(scores: DataFrame) -> DataFrame:
    """The sum of scores: counts are added, ratios taken again."""
    sums = scores.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def average_precision(matches: DataFrame, thresholds: list[float]) -> DataFrame:
    """tp / (tp + fp + fn) pooled at each overlap threshold, from ``matches`` (overlap: null for an unmatched truth or prediction)."""
    rows = matches.select("overlap", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    hit = F.coalesce(F.col("overlap") >= F.col("threshold"), F.lit(False))
    # a pair under the threshold is one false positive and one miss
    size = F.when(F.col("overlap").isNull(), 1).otherwise(F.when(hit, 1).otherwise(2))
    return rows.groupBy("threshold").agg(F.count_if(hit).alias("tp"), F.sum(size).alias("union")).withColumn("ap", ratio(F.col("tp"), F.col("union")))


def pixel_overlap(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Overlap of instances from label rows (image, pixel, label; 0 is background): image, truth_label, pred_label, iou."""
    t, p = truth.where("label > 0").withColumnRenamed("label", "truth_label"), predicted.where("label > 0").withColumnRenamed("label", "pred_label")
    both = t.join(p, ["image", "pixel"]).groupBy("image", "truth_label", "pred_label").agg(F.count("*").alias("n"))
    nt, np_ = t.groupBy("image", "truth_label").agg(F.count("*").alias("nt")), p.groupBy("image", "pred_label").agg(F.count("*").alias("np"))
    return both.join(nt, ["image", "truth_label"]).join(np_, ["image", "pred_label"]).select("image", "truth_label", "pred_label", (F.col("n") / (F.col("nt") + F.col("np") - F.col("n"))).alias("iou"))


def quartile_edges(values: DataFrame, column: str) -> DataFrame:
    """Exact, interpolated quartiles: one row (q25, q50, q75)."""
    return values.agg(*[F.percentile(column, F.lit(q)).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)])


def breakdown(rows: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Recall of truths and precision of predictions per bin (lower, upper] of a property: bin, truth, recall, pred, precision.

    ``rows`` (side: truth or pred, matched, the property).
    """
    bin_ = sum(((F.col(column) > e).cast("int") for e in edges), F.lit(0))
    truth, pred = F.col("side") == "truth", F.col("side") == "pred"
    sums = rows.groupBy(bin_.alias("bin")).agg(F.count_if(truth).alias("truth"), F.count_if(truth & F.col("matched")).alias("found"), F.count_if(pred).alias("pred"), F.count_if(pred & F.col("matched")).alias("right"))
    return sums.select("bin", "truth", F.when(F.col("truth") > 0, F.round(F.col("found") / F.col("truth"), 4)).alias("recall"), "pred", F.when(F.col("pred") > 0, F.round(F.col("right") / F.col("pred"), 4)).alias("precision"))


def error_concentration(errors: DataFrame, group: str, top: int = 5) -> DataFrame:
    """One row: groups with errors, errors in all, and the share of the ``top`` worst groups."""
    counts = errors.groupBy(group).agg(F.count("*").alias("n"))
    worst = counts.orderBy(F.desc("n"), group).limit(top).agg(F.sum("n").alias("worst"))
    return counts.agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_errors")).crossJoin(F.broadcast(worst)).select("n_groups", "n_errors", ratio(F.col("worst"), F.col("n_errors")).alias("top_share"))


def identity_f1(truth: DataFrame, found: DataFrame, tolerance: float) -> DataFrame:
    """Per true track the found track that meets it most often within ``tolerance``, and the F1 of their observations.

    Both have (track_id, frame, x_px, y_px). Points meet on the frame and a grid cell
    of the tolerance with its neighbours, so a crowded frame is no cross product.
    """
    def cell(df: DataFrame) -> DataFrame:
        return df.withColumns({"cx": F.floor(F.col("x_px") / tolerance), "cy": F.floor(F.col("y_px") / tolerance)})

    near = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    t = cell(truth).withColumn("ox", F.explode(near)).withColumn("oy", F.explode(near)).select(F.col("track_id").alias("true_id"), "frame", F.col("x_px").alias("tx"), F.col("y_px").alias("ty"), (F.col("cx") + F.col("ox")).alias("cx"), (F.col("cy") + F.col("oy")).alias("cy"))
    hits = t.join(cell(found), ["frame", "cx", "cy"]).where(F.hypot(F.col("tx") - F.col("x_px"), F.col("ty") - F.col("y_px")) <= tolerance).groupBy("true_id", "track_id").agg(F.count("*").alias("hits"))
    best = hits.withColumn("k", F.row_number().over(Window.partitionBy("true_id").orderBy(F.desc("hits"), "track_id"))).where("k = 1")
    n_true, n_found = truth.groupBy(F.col("track_id").alias("true_id")).agg(F.count("*").alias("n_true")), found.groupBy("track_id").agg(F.count("*").alias("n_found"))
    rows = n_true.join(best, "true_id", "left").join(n_found, "track_id", "left")
    return rows.select("true_id", "track_id", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce(2 * F.col("hits") / (F.col("n_true") + F.col("n_found")), F.lit(0.0)).alias("f1"))
