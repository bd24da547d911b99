"""Result folders with what names their experiment, acquisition and condition."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fields import UNRESOLVED, united
from ..schema import positive
from .results import load_run


@dataclass(frozen=True)
class Folder:
    """A run's names and calibration; what nothing names is ``unknown:<folder>``, and a condition that nothing names is None."""

    path: str
    movie: str
    experiment: str
    acquisition: str
    condition: str | None
    pixel_um: float | None
    interval_min: float | None


def resolve(spark: SparkSession, path: str, conditions: Mapping[str, str] | None = None) -> Folder:
    """Names of the run in ``path``: from its manifest; the condition from ``conditions`` by movie, acquisition or experiment, and else from the manifest. Nothing is guessed from an id."""
    run = load_run(spark, path).manifest
    movie = path.rstrip("/").rpartition("/")[2]
    known = {k: str(run[k]) if run.get(k) else None for k in ("experiment", "acquisition", "condition")}
    scale = run.get("calibration") or {}
    pixel = scale.get("pixel_size_um") if scale.get("spatially_calibrated") is not False else None
    interval = scale.get("frame_interval_min") if scale.get("temporally_calibrated") is not False else None
    named = [conditions[k] for k in (movie, known["acquisition"], known["experiment"]) if conditions and k in conditions]
    return Folder(path, movie, known["experiment"] or UNRESOLVED + movie, known["acquisition"] or UNRESOLVED + movie, str(named[0]) if named else known["condition"], float(pixel) if positive(pixel) else None, float(interval) if positive(interval) else None)


def read_folders(spark: SparkSession, paths: list[str], conditions: Mapping[str, str] | None = None) -> DataFrame:
    """Track rows of all runs with movie, experiment, acquisition and condition; columns that some runs lack are null there."""
    parts = []
    for path in paths:
        f = resolve(spark, path, conditions)
        names = {"movie": f.movie, "experiment": f.experiment, "acquisition": f.acquisition, "condition": f.condition}
        parts.append(load_run(spark, path).table("tracks").withColumns({k: F.lit(v).cast("string") for k, v in names.items()}))
    return united(parts)
