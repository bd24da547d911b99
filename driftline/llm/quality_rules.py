"""Quality rules: fixed limits on document statistics, then boosted trees over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .docstats import COUNTS, FEATURES, statistics
from .workspace import bounded_sample, columns_as, materialise, small_batches

#: Labelled documents that the trees are fitted on at most, chosen by a hash of their id.
MAX_TRAIN = 20_000
#: Limits of the base rules.
LEAST_WORDS, REPEAT_PERCENT = 20, 30


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from .words import by_bytes

    for b in batches:
        texts = b.column("text").to_pylist()
        parts = [statistics(texts[lo:hi]) for lo, hi in by_bytes(texts)]
        if not parts:
            continue
        counts, features = (np.concatenate(x) for x in zip(*parts, strict=True))
        flat = pa.array(features.astype(np.float64).ravel())
        offsets = pa.array(np.arange(len(features) + 1, dtype=np.int32) * features.shape[1])
        yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(counts[:, i]) for i in range(len(COUNTS))], pa.ListArray.from_arrays(offsets, flat)], names=["id", *COUNTS, "features"])


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = columns_as(docs, id=id_col, text=text_col)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, {', '.join(f'{c} bigint' for c in COUNTS)}, features array<double>"
    return rows.mapInArrow(_measure, schema)


def train(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str, max_train: int = MAX_TRAIN) -> boosting.Trees:
    """Trees for P(label = 1), on at most ``max_train`` labelled documents; rows without a label or an id are left out."""
    y = columns_as(labels, id=id_col, y=label_col).where("y is not null").groupBy("id").agg(F.max("y").alias("y"))
    y = materialise(bounded_sample(materialise(y, "labels"), "id", max_train), "sample")
    # max_train rows of a number each at most: a proven bound for broadcasting
    sample = stats.select("id", "features").join(F.broadcast(y), "id").groupBy("id").agg(F.min("features").alias("features"), F.min("y").cast("int").alias("y"))
    # of several texts with one id the least features count; the order is that of a hash, so nothing depends on how rows arrive
    sample = sample.select(F.xxhash64("id").alias("rank"), F.col("id").cast("string").alias("key"), "features", "y").toPandas().sort_values(["rank", "key"])
    x = np.array(sample["features"].tolist(), dtype=float).reshape(len(sample), len(FEATURES))
    return boosting.fit(x, sample["y"].to_numpy(dtype=float), np.array([m for _, m in FEATURES]))


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5, max_train: int = MAX_TRAIN) -> DataFrame:
    """Every document with its counts, base_failed, quality (the trees' probability) and kept.

    A document fails the base rules with fewer than 20 words or with more than 30 %
    of its words in repeated 8-word windows; others are kept if the trees give at
    least ``threshold``. Null and empty texts have no words and fail. Repeated rows
    are judged each by itself. Without labels of both classes the trees give a
    constant, and with no label at all one half, which keeps what the base rules
    keep. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    stats = materialise(measured(docs, id_col, text_col), "statistics")
    model = train(stats, labels, id_col, label_col, max_train)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("features").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(FEATURES))
            p = 1 / (1 + np.exp(-model.margin(x)))
            n, again = (b.column(c).to_numpy(zero_copy_only=False) for c in ("n_words", "n_repeat_words"))
            failed = (n < LEAST_WORDS) | (100 * again > REPEAT_PERCENT * n)
            yield pa.RecordBatch.from_arrays([b.column("id"), *[b.column(c) for c in COUNTS], pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))], names=["id", *COUNTS, "base_failed", "quality", "kept"])

    schema = f"id {stats.schema['id'].dataType.simpleString()}, {', '.join(f'{c} bigint' for c in COUNTS)}, base_failed boolean, quality double, kept boolean"
    return stats.mapInArrow(score, schema).withColumnRenamed("id", id_col)
