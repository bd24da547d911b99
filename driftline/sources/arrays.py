"""Mask archives, registries, and files that must be what they are said to be."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.tables import write_file


def _stacks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
            with np.load(io.BytesIO(content.as_py())) as z:
                masks = z["masks"].astype(np.float32)
            for frame, m in enumerate(masks.reshape(-1, *masks.shape[-2:])):
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([frame], pa.int32()), pa.array([m.shape[0]], pa.int32()), pa.array([m.shape[1]], pa.int32()), pa.array([m.tobytes()], pa.binary())], names=["path", "frame", "height", "width", "pixels"])


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """Mask archives (.npz with an array ``masks``) as one row per frame, like image stacks."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_stacks, "path string, frame int, height int, width int, pixels binary")


def write_masks(spark: SparkSession, path: str, frames: DataFrame) -> None:
    """One movie's label images as a compressed archive; a movie fits the driver, as it fits its viewer."""
    rows = frames.orderBy("frame").select("height", "width", "pixels").collect()
    out = io.BytesIO()
    np.savez_compressed(out, masks=np.stack([np.frombuffer(r.pixels, np.float32).reshape(r.height, r.width) for r in rows]).astype(np.int32))
    write_file(spark, path, out.getvalue())


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry's entries, one JSON object each, in a file that is a list of them or one to a line."""
    return spark.read.option("multiLine", True).json(path)


def write_versioned(spark: SparkSession, folder: str, name: str, entries: list[dict]) -> str:
    """Write entries as the registry's next version, name.1.json, name.2.json, ...; none is ever written over. Returns the path."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    have = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    versions = [int(n[len(name) + 1 : -5]) for n in have if n.startswith(f"{name}.") and n.endswith(".json") and n[len(name) + 1 : -5].isdigit()]
    path = f"{folder}/{name}.{max(versions, default=0) + 1}.json"
    write_file(spark, path, json.dumps(entries, indent=1).encode())
    return path


def verify_locks(spark: SparkSession, files: str, locks: DataFrame) -> DataFrame:
    """Files by name with their SHA-256 and whether the lock (name, sha256) agrees: ok, or missing_lock, changed."""
    found = spark.read.format("binaryFile").load(files).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    return found.join(locks, "name", "left").select("name", "found", F.when(F.col("sha256").isNull(), "missing_lock").when(F.lower("sha256") == F.col("found"), "ok").otherwise("changed").alias("state"))


def refuse_changed(states: DataFrame) -> DataFrame:
    """``states``, or an error as soon as a row of another state than ok is read."""
    return states.where(F.when(F.col("state") == "ok", True).otherwise(F.raise_error(F.concat(F.lit("the file "), F.col("name"), F.lit(" is not the one that was locked"))).cast("boolean")))
