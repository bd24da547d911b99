"""The registered queries ``opN_<name>`` and their SQL: thin uses of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import DigestCache, count_tokens

    # the cache outlives the query where the session names a folder for it
    path = spark.conf.get("spark.driftline.tokenCache", None)
    cache = DigestCache(spark, path) if path else None
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache, limit=1024)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_boilerplate

    return drop_boilerplate(_table(spark, sf_dir, "documents"), min_sites=5)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    rows = assign_shards(_table(spark, sf_dir, "documents"), n_shards=40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import find_leaks

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = find_leaks(docs, _table(spark, sf_dir, "benchmark"), threshold=0.75)
    best = F.array_max(F.transform("leaks", lambda x: x["similarity"]))
    contaminated = F.size("leaks") > 0
    return rows.select("document.doc_id", contaminated.alias("contaminated"), (~contaminated).alias("kept"), F.array_sort(F.array_distinct(F.transform("leaks", lambda x: x["item"]))).alias("item_ids"), best.alias("best_similarity"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify

    rows = classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), carry=["doc_id"])
    return rows.select("document.doc_id", "doc_quality", "host_quality", "path_quality", "score", "kept")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_classes

    return jaccard_classes(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_and_index

    rows = archive_and_index(_table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_rank")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), order=4, least=1)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import apply_rules

    return apply_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    rows = mix_sources(_table(spark, sf_dir, "documents"), max_repeats=2.0, budget_tokens="corpus", carry=["doc_id"])
    return rows.select("document.doc_id", "source", "n_tokens", "quota", "epoch", "at_token")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_line_dedup, op3_sharding, op4_decontamination, op5_quality_classifier, op6_jaccard_join, op7_warc, op8_lm_scoring, op9_quality_rules, op10_source_mixing)}


def oracle_sql() -> dict[str, str]:
    from . import line_dedup, mixing, warc

    return {"op2_line_dedup": line_dedup.SQL, "op7_warc": warc.SQL, "op10_source_mixing": mixing.SQL}
