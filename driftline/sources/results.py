"""Saved runs: a folder of CSV tables and a JSON manifest, read with explicit types."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.legacy import upgrade_tracks, upgrade_unlinked
from ..schema import Scale

# The tables of a run, their columns and which are not numbers.
WHOLE = {"frame", "source_frame", "label", "channel", "extent_px", "track_id", "det_label", "observation_index", "n_observations", "gap_frames", "lag_frames", "n_pairs", "n_gaps", "total_missing_frames", "span_frames", "first_frame", "last_frame", "raw_instances", "kept_instances", "removed_instances", "detections", "candidate_tracks", "matched", "new_tracks", "dormant", "terminated", "starts_at_frame", "nearest_earlier_track", "that_track_ended_at_frame", "first_pass_track_id", "bbox_min_x", "bbox_min_y", "bbox_min_z", "bbox_max_x", "bbox_max_y", "bbox_max_z"}
TEXT = {"source", "detection_source", "track_flags", "flags", "dimensionality", "severity", "code", "title", "detail", "notes", "merge_suspected", "split_suspected", "gap_closed", "refused_because", "explanation", "cellpose_message", "tier", "reason", "outcome"}
YES_NO = {"touches_border"}
TABLES = ("detections", "tracks", "track_summary", "track_msd", "segmentation_diagnostics", "tracking_events", "qc_issues", "recovery_attempts", "unlinked_starts")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table typed by its columns' names: whole numbers, text, yes/no, else floating point.

    An empty cell is null. A cell that is not of its column's type is null there and
    kept, as text, in ``<column>_text``, which is only there if the table has such a
    cell. A missing file is an empty table without columns.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], "missing int").drop("missing")
    raw = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"').option("nullValue", "").csv(path)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    kind = {c: "string" if c in TEXT else "boolean" if c in YES_NO else "int" if c in WHOLE else "double" for c in raw.columns}
    wrong = {c: F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(k).isNull() for c, k in kind.items() if k != "string"}
    bad = raw.agg(*[F.max(w).alias(c) for c, w in wrong.items()]).first() if wrong else None
    out = raw.select(*[F.col(f"`{c}`").try_cast(k).alias(c) for c, k in kind.items()], *[F.when(w, F.col(f"`{c}`")).alias(f"{c}_text") for c, w in wrong.items() if bad[c]])
    return out


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The run's manifest; a missing or broken one is empty."""
    if not _exists(spark, path):
        return {}
    try:
        found = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


@dataclass
class SavedRun:
    """A run's manifest and tables, with point lookups; tables are read when asked for."""

    spark: SparkSession
    folder: str
    manifest: dict

    def table(self, name: str) -> DataFrame:
        rows = read_table(self.spark, f"{self.folder}/{name}.csv")
        if self.manifest.get("schema_version", 1) < 2:
            axis = self.manifest.get("confinement") or {}
            if name == "tracks" and rows.columns:
                rows = upgrade_tracks(rows)
            if name == "unlinked_starts" and rows.columns:
                rows = upgrade_unlinked(rows, axis.get("ux"), axis.get("uy"))
        return rows

    def frame(self, frame: int, name: str = "tracks") -> DataFrame:
        return self.table(name).where(F.col("frame") == frame)

    def track(self, track_id: int, name: str = "tracks") -> DataFrame:
        return self.table(name).where(F.col("track_id") == track_id)

    def track_ids(self) -> DataFrame:
        return self.table("tracks").select("track_id").distinct().orderBy("track_id")

    def scale(self) -> Scale:
        """The calibration that the manifest tells."""
        told = self.manifest.get("calibration") or {}
        pixel = told.get("pixel_size_um") if told.get("spatially_calibrated") is not False else None
        interval = told.get("frame_interval_min") if told.get("temporally_calibrated") is not False else None
        return Scale.of(pixel, interval, told.get("z_step_um"))

    def msd(self, track_id: int) -> DataFrame:
        """Displacements of a track; made from its rows where the run was saved without them."""
        if _exists(self.spark, f"{self.folder}/track_msd.csv"):
            return self.track(track_id, "track_msd").orderBy("lag_frames")
        from ..sinks.bundles import displacements

        return displacements(self.track(track_id), self.scale())


def is_complete(spark: SparkSession, folder: str) -> bool:
    """Whether a run was saved to its end: the manifest is written last."""
    return _exists(spark, f"{folder}/run.json") and _exists(spark, f"{folder}/tracks.csv")


def load_run(spark: SparkSession, folder: str) -> SavedRun:
    return SavedRun(spark, folder, read_manifest(spark, f"{folder}/run.json"))
