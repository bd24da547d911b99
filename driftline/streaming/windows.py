"""Windows over event time; the same functions serve tables and streams unless said otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tumbling_counts(rows: DataFrame, width: str, watermark: str | None = None, time: str = "ts") -> DataFrame:
    """Events by window and type: start, event_type, n. A stream needs a watermark to let go of old windows."""
    rows = rows.withWatermark(time, watermark) if watermark else rows
    counts = rows.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "n")


def sliding_counts(rows: DataFrame, width: str, step: str, watermark: str | None = None, time: str = "ts") -> DataFrame:
    """As tumbling_counts, with windows that begin every ``step``."""
    rows = rows.withWatermark(time, watermark) if watermark else rows
    counts = rows.groupBy(F.window(time, width, step).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(rows: DataFrame, gap_seconds: int, by: str = "user_id", time: str = "ts") -> DataFrame:
    """Runs of events without a pause of more than ``gap_seconds``: by, started, ended, n. Tables only; a stream uses session_window."""
    w = Window.partitionBy(by).orderBy(time)
    pause = F.timestamp_diff("MICROSECOND", F.lag(time).over(w), F.col(time)) > gap_seconds * 1_000_000
    marked = rows.select(by, time, F.coalesce(pause.cast("int"), F.lit(1)).alias("new"))
    numbered = marked.withColumn("k", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(by, "k").agg(F.min(time).alias("started"), F.max(time).alias("ended"), F.count("*").alias("n")).drop("k")
