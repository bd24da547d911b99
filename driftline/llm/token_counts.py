"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised content; a tokenizer's is the
SHA-256 of its vocabulary file with the library's version. Counts are looked up
by both, only distinct misses are encoded, and the new counts are appended. Digests
travel first; a text moves only if its digest is missing, and once.
"""

from __future__ import annotations

import functools
import hashlib
import importlib.metadata
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import columns_as, exists, few_files, fresh_path, materialise, small_batches

CACHE_SCHEMA = "digest binary, n_tokens bigint"
#: Missing digests (32 bytes each) that are sent to all executors, so that only missing texts are shuffled.
FEW_MISSES = 200_000


def library_of(path: str) -> str:
    return "sentencepiece" if path.endswith(".model") else "tokenizers"


def tokenizer_version(path: str) -> str:
    """Digest of what decides the counts: the vocabulary's bytes and the library's version."""
    library = library_of(path)
    seen = hashlib.sha256(f"{library} {importlib.metadata.version(library)}\n".encode())
    with open(path, "rb") as f:
        seen.update(f.read())
    return seen.hexdigest()


@functools.lru_cache(maxsize=4)
def _encoder(path: str):
    if library_of(path) == "sentencepiece":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    encode = getattr(model, "encode_batch_fast", model.encode_batch)
    return lambda texts: [len(x) for x in encode(texts, add_special_tokens=False)]


#: Characters encoded at once in a worker.
ENCODE_CHARS = 1 << 18


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .words import by_bytes

        count = _encoder(path)
        for b in batches:
            texts = b.column("content").to_pylist()
            n: list[int] = []
            for lo, hi in by_bytes(texts, ENCODE_CHARS):
                n += count(texts[lo:hi])
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return run


class DigestCache:
    """Counts at rest: a folder for each tokenizer version, in it a folder of Parquet files for each append.

    Appends don't share a folder, so several writers may append at once. Two of them
    may append the same digest; counts of one digest are equal, so a reader takes
    any one of them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def counts(self, tokenizer: str) -> DataFrame | None:
        """digest and n_tokens of all texts counted so far; None if there are none."""
        folder = f"{self.path}/tokenizer={tokenizer}"
        if not exists(self.spark, folder):
            return None
        return self.spark.read.schema(CACHE_SCHEMA).parquet(folder).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, tokenizer: str, rows: DataFrame) -> None:
        few_files(rows.select("digest", "n_tokens")).write.parquet(f"{self.path}/tokenizer={tokenizer}/batch={uuid.uuid4().hex}")


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: DigestCache | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Tokens of every whole text: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``), digest (hex).

    Content is normalised only in that a null text is an empty one (0 tokens):
    anything more could change a byte-level tokenizer's count. Special strings in
    a text are treated as the library does by default. Repeated rows and equal
    texts each keep their row; the text is encoded once. Columns other than the
    two named are not read. Without a cache, one is begun in the shared folder.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tokenizer = tokenizer_version(tokenizer_path)
    cache = cache or DigestCache(spark, fresh_path(spark, "token_cache"))
    content = columns_as(docs, id=id_col, content=text_col).withColumn("content", F.coalesce("content", F.lit("")))
    keyed = content.withColumn("digest", F.unhex(F.sha2("content", 256)))
    rows = materialise(keyed.select("id", "digest", F.octet_length("content").cast("bigint").alias("n_bytes")), "digests")
    asked = materialise(rows.select("digest").distinct(), "asked")
    known = cache.counts(tokenizer)
    misses = asked if known is None else materialise(asked.join(known, "digest", "left_anti"), "misses")
    n_misses = misses.count()
    if n_misses:
        texts = keyed.select("digest", "content")
        if known is not None and n_misses <= FEW_MISSES:
            texts = texts.join(F.broadcast(misses), "digest", "left_semi")
        # one text per digest after partial aggregation, so a group of copies of any size is one row per task
        texts = texts.groupBy("digest").agg(F.first("content").alias("content"))
        if known is not None and n_misses > FEW_MISSES:
            texts = texts.join(misses, "digest", "left_semi")
        cache.append(tokenizer, texts.mapInArrow(_encode(tokenizer_path), CACHE_SCHEMA))
        known = cache.counts(tokenizer)
    counts = asked.withColumn("n_tokens", F.lit(0).cast("bigint")) if known is None else asked.join(known, "digest")
    # written, so that the join below is of two plain tables and a digest of many rows can be split
    counts = materialise(counts.select("digest", "n_tokens"), "counts")
    out = rows.join(counts, "digest", "left")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.lower(F.hex("digest")).alias("digest"))
