"""Observations from the event stream: users are tracks, hours are frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Micrometres are not in the stream: x is the event's value and y its key, both in pixels.
START = "2024-01-01 00:00:00"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def observations(rows: DataFrame) -> DataFrame:
    """One row per (track, frame): track_id, frame, x_px, y_px, x_c (hundredths of x), area_px, source, det_label.

    The earliest event of a user's hour stands for it; later ones are dropped, for a
    track has one observation in a frame. det_label numbers a frame's observations.
    """
    frame = F.expr(f"CAST(timestampdiff(HOUR, TIMESTAMP_NTZ'{START}', CAST(ts AS TIMESTAMP_NTZ)) AS INT)")
    first = Window.partitionBy("user_id", "frame").orderBy("ts", "event_id")
    kept = rows.select("event_id", "ts", "user_id", "event_type", "value", "props", frame.alias("frame")).withColumn("k", F.row_number().over(first)).where("k = 1")
    return kept.select(
        F.col("user_id").alias("track_id"),
        "frame",
        F.col("value").alias("x_px"),
        F.get_json_object("props", "$.k").cast("double").alias("y_px"),
        F.round(F.col("value") * 100).cast("bigint").alias("x_c"),
        (F.abs("value") + 1).alias("area_px"),
        F.when(F.col("event_type") == "error", "window").when(F.col("event_type") == "signup", "permissive").otherwise("primary").alias("source"),
        F.row_number().over(Window.partitionBy("frame").orderBy("event_id")).alias("det_label"),
    )


OBS_SQL = """obs AS (
  SELECT track_id, frame, x_px, y_px, x_c, area_px, source,
         CAST(row_number() OVER (PARTITION BY frame ORDER BY event_id) AS INTEGER) AS det_label
  FROM (
    SELECT event_id, user_id AS track_id, CAST((epoch_us(ts) - 1704067200000000) // 3600000000 AS INTEGER) AS frame,
           value AS x_px, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y_px,
           CAST(round(value * 100) AS BIGINT) AS x_c, abs(value) + 1 AS area_px,
           CASE event_type WHEN 'error' THEN 'window' WHEN 'signup' THEN 'permissive' ELSE 'primary' END AS source,
           row_number() OVER (PARTITION BY user_id, (epoch_us(ts) - 1704067200000000) // 3600000000 ORDER BY ts, event_id) AS k
    FROM events) WHERE k = 1
)"""
