"""Copies of saved runs, and single tables out of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.pairs import squared_displacements
from ..operators.summary import SUMMARY_COLUMNS
from ..schema import Scale
from ..sources.results import SavedRun
from .tables import write_csv

#: What a bundle holds, in its order; columns of the displacement table and of the verdicts.
BUNDLE = ("tracks.csv", "track_summary.csv", "track_msd.csv", "detections.csv", "segmentation_diagnostics.csv", "tracking_events.csv", "qc_issues.csv", "recovery_attempts.csv", "unlinked_starts.csv", "run.json", "masks.npz", "preview.png")
MSD_COLUMNS = ("track_id", "lag_frames", "lag_time_min", "lag_time_hr", "n_pairs", "msd_um2", "msd_px2")
VERDICT_COLUMNS = ("object_id", "t", "z", "state", "reasons")


def _copy(spark: SparkSession, source: str, target: str) -> bool:
    """Copies a file or a folder, byte for byte, through Hadoop's file systems; False where there is none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    here = a.getFileSystem(conf)
    if not here.exists(a):
        return False
    there = b.getFileSystem(conf)
    there.delete(b, True)
    return bool(jvm.org.apache.hadoop.fs.FileUtil.copy(here, a, there, b, False, conf))


def displacements(tracks: DataFrame, scale: Scale) -> DataFrame:
    """The displacement table of a run that was saved without one."""
    rows = tracks.selectExpr("track_id", "CAST(frame AS INT) AS frame", "CAST(round(x_px * 100) AS BIGINT) AS x_c", "CAST(y_px AS DOUBLE) AS y_px")
    return squared_displacements(rows, scale).selectExpr("track_id", "lag_frames", "lag_time_min", "lag_time_min / 60 AS lag_time_hr", "n_pairs", "msd_um2", "msd_px2").orderBy("track_id", "lag_frames")


def export_bundle(run: SavedRun, target: str, scale: Scale) -> list[str]:
    """Copies a run's files to ``target``; a displacement table that it lacks is made from its tracks. Gives the names written."""
    written = []
    for name in BUNDLE:
        if _copy(run.spark, f"{run.folder}/{name}", f"{target}/{name}"):
            written.append(name)
        elif name == "track_msd.csv":
            tracks = run.table("tracks")
            if tracks.columns and not tracks.isEmpty():
                write_csv(displacements(tracks, scale), f"{target}/{name}", MSD_COLUMNS)
                written.append(name)
    return written


def export_table(run: SavedRun, name: str, path: str, single: bool = True) -> None:
    """A whole table of a run in the columns of its kind: ``tracks``, ``track_summary`` or ``track_msd``."""
    columns = {"track_summary": SUMMARY_COLUMNS, "track_msd": MSD_COLUMNS}.get(name)
    write_csv(run.table(name), path, columns, single)


def export_verdicts(decided: DataFrame, path: str, single: bool = True) -> None:
    """Objects' verdicts with their reasons, one row for each object and time, and any further evidence after them."""
    more = [c for c in decided.columns if c not in VERDICT_COLUMNS]
    write_csv(decided, path, [*VERDICT_COLUMNS, *more], single)
