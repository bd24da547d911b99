"""What a caller may plug in: a segmenter, a proposer, weights of a score, and a run by stages that reports and can be stopped."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Mapping, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .imaging import image


class Segmenter(Protocol):
    """An image to a label image of the same shape; 0 is background."""

    def __call__(self, image: np.ndarray) -> np.ndarray: ...


class Proposer(Protocol):
    """An image and an expected place (x, y) to candidates (x, y, confidence)."""

    def __call__(self, image: np.ndarray, expected: tuple[float, float]) -> Sequence[tuple[float, float, float]]: ...


def segmented(frames: DataFrame, segmenter: Segmenter) -> DataFrame:
    """Label pixels (movie, frame, label, y, x, value) of every frame (movie, frame, height, width, pixels); frames are segmented one by one, wherever they lie."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                values = image(r.pixels, r.height, r.width)
                labels = np.asarray(segmenter(values))
                if labels.shape != values.shape:
                    raise ValueError(f"a segmenter made {labels.shape} of an image of {values.shape}")
                y, x = np.nonzero(labels)
                yield pd.DataFrame({"movie": r.movie, "frame": r.frame, "label": labels[y, x].astype(int), "y": y, "x": x, "value": values[y, x].astype(float)})

    return frames.mapInPandas(run, "movie bigint, frame int, label int, y int, x int, value double")


def proposed(expected: DataFrame, frames: DataFrame, proposer: Proposer, least: float = 0.0) -> DataFrame:
    """The best candidate for each expected position (movie, frame, track_id, x, y), with its confidence: the highest of ``least`` or more, ties to the first; no row without one."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                found = [c for c in proposer(image(r.pixels, r.height, r.width), (r.x, r.y)) if c[2] >= least]
                if found:
                    out.append((r.movie, r.frame, r.track_id, *map(float, max(found, key=lambda c: c[2]))))
            yield pd.DataFrame(out, columns=["movie", "frame", "track_id", "x", "y", "confidence"])

    return expected.join(frames, ["movie", "frame"]).mapInPandas(run, "movie bigint, frame int, track_id bigint, x double, y double, confidence double")


def weighted(rows: DataFrame, weights: Mapping[str, float | Callable[[Column], Column]], name: str = "score") -> DataFrame:
    """``rows`` with a score: each named column times its weight, or through its function; missing values count nothing. Functions give expressions, so scoring stays in the plan."""
    terms = [w(F.col(c)) if callable(w) else F.col(c) * w for c, w in weights.items()]
    return rows.withColumn(name, sum((F.coalesce(t.cast("double"), F.lit(0.0)) for t in terms), F.lit(0.0)))


class Cancelled(Exception):
    """A run was stopped; its message names the stage."""


class StagedRun:
    """Runs named stages one after another, says how far it is, and can be stopped between and within stages."""

    def __init__(self, spark: SparkSession, report: Callable[[str, int, int], None] | None = None):
        self.spark, self.report = spark, report or (lambda *_: None)
        self.tag, self.stopped = f"driftline-{uuid.uuid4().hex}", threading.Event()

    def cancel(self) -> None:
        """Stops the run, and its Spark jobs where they are."""
        self.stopped.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def run(self, stages: Sequence[tuple[str, Callable[[object], object]]], value: object = None) -> object:
        """Each stage gets what the one before gave. Raises Cancelled after ``cancel``; a stage's own error passes through otherwise."""
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            for k, (name, stage) in enumerate(stages):
                if self.stopped.is_set():
                    raise Cancelled(name)
                self.report(name, k, len(stages))
                try:
                    value = stage(value)
                except Exception as e:
                    if self.stopped.is_set():
                        raise Cancelled(name) from e
                    raise
            self.report("done", len(stages), len(stages))
            return value
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)
