"""Groups of equal content, guards against leakage between groups, lineage, and components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_groups(rows: DataFrame, key: str, content: str) -> DataFrame:
    """Contents that several rows have: digest, n, first_id, last_id. Rows meet as digests, and groups of any size as one row per task."""
    digest = F.sha2(F.col(content), 256)
    return rows.where(F.col(content).isNotNull()).groupBy(digest.alias("digest")).agg(F.count("*").alias("n"), F.min(key).alias("first_id"), F.max(key).alias("last_id")).where("n > 1")


def straddling(rows: DataFrame, unit: str, group: str) -> DataFrame:
    """Units that lie in several groups: unit, n_groups. A split must have none."""
    return rows.groupBy(unit).agg(F.count_distinct(group).alias("n_groups")).where("n_groups > 1")


def refuse_straddling(rows: DataFrame, unit: str, group: str) -> DataFrame:
    """``rows``, or an error as soon as one unit lies in several groups."""
    bad = straddling(rows, unit, group).limit(1).collect()
    if bad:
        raise ValueError(f"{unit} {bad[0][0]} lies in {bad[0][1]} groups of {group}")
    return rows


def held_out(rows: DataFrame, never: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not on the list that must never be used."""
    return rows.join(never.select(key).distinct(), key, "left_anti")


def split_summary(rows: DataFrame, split: str, unit: str) -> DataFrame:
    """Units and rows of each split."""
    return rows.groupBy(split).agg(F.count_distinct(unit).alias("n_units"), F.count("*").alias("n_rows"))


def _cut(spark, checkpoint=None):
    """How a round's table is cut off from its lineage: as asked, or by a checkpoint in the folder that the session names."""
    if checkpoint:
        return checkpoint
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="driftline-"))
    return lambda df: df.checkpoint()


def lineage(edges: DataFrame, start: int | DataFrame, checkpoint=None) -> DataFrame:
    """All ancestors of ``start`` (a node, or a table of them in column ``node``) over ``edges`` (child, parent), with their least distance, however far; a start has distance 0. Cycles end where they close."""
    spark = edges.sparkSession
    cut = _cut(spark, checkpoint)
    first = start if isinstance(start, DataFrame) else spark.createDataFrame([(start,)], "node bigint")
    known = edge = first.select(F.col("node").cast("bigint").alias("node"), F.lit(0).alias("depth")).distinct()
    edges = edges.select(F.col("child").cast("bigint").alias("node"), F.col("parent").cast("bigint").alias("parent")).where("parent is not null")
    depth = 0
    while True:
        depth += 1
        edge = cut(edge.join(edges, "node").select(F.col("parent").alias("node")).distinct().join(known, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if edge.isEmpty():
            return known
        known = cut(known.unionByName(edge))


def components(links: DataFrame, checkpoint=None) -> DataFrame:
    """(node, root): the least node that links (a, b) reach, by minimum labels with pointer jumping, until no label changes.

    ``checkpoint`` cuts the lineage of each round; without it, rounds are checkpoints
    in the folder that ``spark.checkpoint.dir`` names. All joins sort: a round's labels
    would fill the driver as a broadcast, however small they are when packed.
    """
    cut = _cut(links.sparkSession, checkpoint)
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near.hint("merge"), "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        after = cut(step.join(labels.select(F.col("node").alias("root"), F.col("root").alias("next")).hint("merge"), "root").select("node", "old", F.least("root", "next").alias("root")))
        labels = after.select("node", "root")
        if after.where("old <> root").isEmpty():
            return labels
