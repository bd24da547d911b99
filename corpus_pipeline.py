"""A corpus from raw documents to shards: five stages, each a table to the next.

Quality classifier, n-gram Jaccard join, benchmark decontamination, mixing sources
to target weights, sharding. Every stage takes (spark, docs, sf_dir) and returns a
DataFrame; ``run`` writes each as Parquet in the shared folder and rereads it, so a
lost executor costs one stage's rest at most. Each stage gives an empty result for
an empty table; nulls and repeated rows are handled as its operator says. A stage's
intermediate tables go when the next stage begins: by then its result has been
written, and is what the next one reads.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.decontamination import find_leaks
from driftline.llm.jaccard_join import keep_one
from driftline.llm.mixing import mix_sources
from driftline.llm.quality_classifier import classify
from driftline.llm.sharding import assign_shards
from driftline.llm.workspace import delete, given, materialise, roots_of

#: Folders that the stage before left.
_left: list[str] = []


def _stage(f):
    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = roots_of(docs)
        for folder in [x for x in _left if not any(x in path for path in read)]:
            delete(spark, folder)
            _left.remove(folder)
        before = set(given())
        out = f(spark, docs, sf_dir)
        _left.extend(x for x in given() if x not in before)
        return out

    return run



@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels).where("kept").select("document.*")


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return keep_one(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_leaks(docs, benchmark).where(F.size("leaks") == 0).select("document.*")


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The flattest mix that reads no source more than twice and every document at least once; a document read twice is there twice."""
    return mix_sources(docs, max_repeats=2.0, budget_tokens=None).select("document.*")


@_stage
def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, text and all, with its shard of 40 and its slot there: what a writer of shards needs."""
    rows = assign_shards(docs, n_shards=40, carry=True)
    return rows.select("document.*", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]
#: A fitted classifier decides the first stage: SQL cannot express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name, wide=True)
    return docs
