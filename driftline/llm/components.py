"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .workspace import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the least node of its component.

    Each round takes the least label around a node, then the label's own label, so
    a chain of length n settles in about log2(n) rounds. Every round is a written
    table: neither links nor labels reach the driver, only the count of changes.
    """
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(around, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = step.join(labels.select(F.col("node").alias("root"), F.col("root").alias("next")), "root")
        seen = Observation()
        after = jump.select("node", "old", F.least("root", "next").alias("root")).observe(seen, F.count_if(F.col("old") != F.col("root")).alias("changed"))
        # the count of changes comes with the write itself
        labels = materialise(after, "labels").select("node", "root")
        if not seen.get["changed"]:
            return labels
