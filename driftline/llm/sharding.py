"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Groups of equal texts are placed in order of falling size, each where the dot
product of its vector with the shard's residual capacity is highest. Packing goes
by levels: first the groups of over 1/1024 of a shard's capacity, of which there can
be few, all in one block; then those of over 1/1024 of that, and so on. Within a
level, groups are dealt by digest into blocks of bounded size that pack side by
side, each into its part of the capacity that the levels before have left.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .mixing import n_words
from .workspace import columns_as, materialise

#: Groups that one block of a lower level packs, about.
BLOCK_GROUPS = 20_000
#: A level's groups are at least this part (two to the power of minus so much) of the largest of the level before.
LEVEL_BITS = 10
#: A group that exceeds a shard is split into pieces of at most this part of a shard.
PIECE = 1 / 8
#: Importance of bytes, tokens and rows in the dot product.
WEIGHTS = (4.0, 1.0, 1.0)
#: Rows of a shard that are numbered in one task, about.
SLOT_ROWS = 50_000
DIMENSIONS = ("bytes", "tokens", "rows")


def pack(vectors: np.ndarray, residual: np.ndarray, turn: int = 0) -> np.ndarray:
    """Shards for ``vectors`` (n x 3), placed in the given order into ``residual`` (shards x 3), which is changed.

    Both are in fractions of one shard's capacity. Each vector goes where its
    weighted dot product with the residual is highest; ties go to the next shard
    from ``turn`` on.
    """
    n_shards = len(residual)
    order = (np.arange(n_shards) + turn) % n_shards
    left = residual[order]
    out = np.empty(len(vectors), dtype=np.int32)
    for i, v in enumerate(vectors):
        s = int((left @ (v * WEIGHTS)).argmax())
        out[i] = order[s]
        left[s] -= v
    residual[order] = left
    return out


def _pack_block(capacity: np.ndarray, residual: np.ndarray):
    """Packs a block into its share of what is left: ``residual`` (shards x 3), in proportion to what the block holds."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*DIMENSIONS, "digest", "piece"], ascending=[False, False, False, True, True], kind="stable")
        v = pdf[list(DIMENSIONS)].to_numpy(dtype=float) / capacity
        total = residual.sum(axis=0)
        share = np.divide(v.sum(axis=0), total, out=np.zeros(3), where=total > 0)
        shard = pack(v, residual * share, int(pdf["block"].iloc[0]))
        return pdf[["digest", "piece", *DIMENSIONS]].assign(shard=shard)

    return run


def _pack_levels(units: DataFrame, capacity: np.ndarray, n_shards: int) -> DataFrame:
    """``units`` (digest, piece, bytes, tokens, rows) with their shard."""
    largest = F.greatest(*[F.col(d) / float(c) for d, c in zip(DIMENSIONS, capacity, strict=True)])
    level = F.greatest(F.lit(0), F.floor(-F.log2(largest) / LEVEL_BITS)).cast("int")
    units = materialise(units.withColumn("level", level), "units")
    residual, done = np.ones((n_shards, 3)), []
    for r in units.groupBy("level").agg(F.count("*").alias("n")).orderBy("level").collect():
        # a level has at most n_shards * 3 * 2 ** LEVEL_BITS groups for each of its blocks
        blocks = min(1 << (LEVEL_BITS * r["level"]), max(1, math.ceil(r["n"] / BLOCK_GROUPS)))
        mine = units.where(F.col("level") == r["level"]).withColumn("block", F.pmod(F.xxhash64("digest", "piece"), F.lit(blocks)).cast("int"))
        schema = "digest binary, piece int, bytes bigint, tokens bigint, rows bigint, shard int"
        packed = materialise(mine.groupBy("block").applyInPandas(_pack_block(capacity, residual), schema), "packed")
        for x in packed.groupBy("shard").agg(*[F.sum(d).alias(d) for d in DIMENSIONS]).collect():
            residual[x["shard"]] -= np.array([float(x[d]) for d in DIMENSIONS]) / capacity
        done.append(packed.select("digest", "piece", "shard"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def assign_shards(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Every row with its shard: id, text digest (16 bytes), size, text_crc32, shard, slot; with ``carry``, all columns as a struct ``document`` too.

    Size is the text's UTF-8 bytes plus 16, tokens its words between blanks. Equal
    texts share a shard unless their group alone exceeds a shard's capacity (its
    mean load) in bytes, tokens or rows; then its rows are counted off in turn into
    equal pieces of an eighth of that. A null text has size 16 and groups with empty texts.
    Rows are told apart by where they lie, so null and repeated ids are placed like
    any others. slot numbers a shard's rows from 0 without gaps. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    content = F.coalesce("text", F.lit(""))
    base = columns_as(docs, id=id_col, text=text_col) if not carry else docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    base = base.select(
        "id",
        F.unhex(F.md5(content)).alias("digest"),
        (F.octet_length(content) + 16).cast("bigint").alias("size"),
        F.crc32(content).alias("text_crc32"),
        n_words(F.col("text")).alias("tokens"),
        F.monotonically_increasing_id().alias("row"),
        *(["document"] if carry else []),
    )
    base = materialise(base, "rows", wide=True)
    rows = base.drop("document")
    # rows numbered by one task of the scan, of one text: of bounded number however frequent the text
    runs = materialise(rows.groupBy("digest", F.shiftright("row", 33).alias("task")).agg(F.count("*").alias("rows"), F.max("size").alias("size"), F.max("tokens").alias("tokens")), "runs")
    groups = runs.groupBy("digest").agg(F.sum("rows").alias("rows"), (F.sum("rows") * F.max("size")).alias("bytes"), (F.sum("rows") * F.max("tokens")).alias("tokens"))
    groups = materialise(groups, "groups")
    totals = groups.agg(*[F.sum(d) for d in DIMENSIONS]).first()
    if totals[2] is None:
        out = rows.select(F.col("id").alias(id_col), "digest", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
        return out.withColumn("document", F.lit(None).cast(base.schema["document"].dataType)) if carry else out
    capacity = np.maximum(np.array([float(x) for x in totals]) / n_shards, 1e-9)
    need = F.greatest(*[F.col(d) / float(c) for d, c in zip(DIMENSIONS, capacity, strict=True)])
    pieces = F.when(need <= 1 + 1e-9, 1).otherwise(F.least(F.ceil(need / PIECE), F.col("rows"))).cast("int")
    groups = groups.withColumn("pieces", pieces).withColumn("unit", (F.col("bytes") / F.col("rows")).cast("bigint")).withColumn("words", (F.col("tokens") / F.col("rows")).cast("bigint"))
    units = groups.select("digest", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "pieces", "rows", "unit", "words")
    count = (F.floor(F.col("rows") / F.col("pieces")) + (F.col("piece") < F.col("rows") % F.col("pieces")).cast("int")).cast("bigint")
    units = units.withColumn("rows", count).select("digest", "piece", (F.col("rows") * F.col("unit")).alias("bytes"), (F.col("rows") * F.col("words")).alias("tokens"), "rows")
    packed = materialise(_pack_levels(units, capacity, n_shards), "placed")
    # split groups: fewer than n_shards for each dimension
    split = materialise(groups.where("pieces > 1").select("digest", "pieces"), "split")
    before = Window.partitionBy("digest").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.join(split, "digest").select("digest", "task", "pieces", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("digest", "task").orderBy("row")
    counted = rows.withColumn("task", F.shiftright("row", 33)).join(offsets, ["digest", "task"])
    counted = counted.withColumn("piece", F.pmod(F.col("offset") + F.row_number().over(within) - 1, F.col("pieces")).cast("int"))
    names = ("id", "digest", "size", "text_crc32", "row")
    big = counted.select(*names, "piece").join(packed, ["digest", "piece"]).select(*names, "shard")
    small = rows.join(packed.join(split.select("digest"), "digest", "left_anti").select("digest", "shard"), "digest").select(*names, "shard")
    out = number_slots(small.unionByName(big), n_rows=int(totals[2]), n_shards=n_shards)
    if carry:
        out = out.join(base.select("row", "document"), "row")
    return out.drop("row").withColumnRenamed("id", id_col)


def number_slots(placed: DataFrame, n_rows: int, n_shards: int) -> DataFrame:
    """Adds slot: 0, 1, ... within each shard of ``placed`` (row, shard, ...), over runs of bounded size instead of one window per shard."""
    runs = max(1, math.ceil(n_rows / n_shards / SLOT_ROWS)) * 4
    placed = materialise(placed.withColumn("run", F.pmod(F.xxhash64("row"), F.lit(runs)).cast("int")), "shards")
    counts = placed.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = placed.withColumn("k", F.row_number().over(Window.partitionBy("shard", "run").orderBy("row")) - 1)
    return numbered.join(offsets, ["shard", "run"]).withColumn("slot", (F.col("offset") + F.col("k")).cast("bigint")).drop("run", "k", "offset")
