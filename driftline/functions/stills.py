"""Stills that are frames of a longer recording, and the random choices made for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the form of a still's label, such as ``t:42/54 - 052924_2.nd2 (series 01)``.
STILL = r"\bt:(\d+)\s*/\s*(\d+)\s*-\s*(.+?)\s*\(series\s*(\d+)\)"


def still(label: Column) -> Column:
    """A label's parts: struct (frame, frames, name, series, recorded); all null if it has another form. recorded is a date that the name starts with (yyyymmdd or mmddyy), if it does."""
    part = lambda k: F.nullif(F.regexp_extract(label, STILL, k), F.lit(""))
    name = part(3)
    long, short = F.regexp_extract(name, r"^(\d{8})(?!\d)", 1), F.regexp_extract(name, r"^(\d{6})(?!\d)", 1)
    day = F.coalesce(F.try_to_timestamp(F.nullif(long, F.lit("")), F.lit("yyyyMMdd")), F.try_to_timestamp(F.nullif(short, F.lit("")), F.lit("MMddyy"))).cast("date")
    return F.struct(part(1).cast("int").alias("frame"), part(2).cast("int").alias("frames"), name.alias("name"), part(4).cast("int").alias("series"), day.alias("recorded"))


def draw(seed: int, *key: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the key alone: the same in every run, on every executor."""
    return F.crc32(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key])) / F.lit(4294967296.0)


def augmentation(seed: int, *key: Column) -> Column:
    """The changes made to an image of that key: struct (flip_x, flip_y, turns, gain, offset), replayed from its key."""
    u = lambda name: draw(seed, F.lit(name), *key)
    return F.struct((u("flip_x") < 0.5).alias("flip_x"), (u("flip_y") < 0.5).alias("flip_y"), F.floor(u("turns") * 4).cast("int").alias("turns"), (0.8 + 0.4 * u("gain")).alias("gain"), (0.1 * (u("offset") - 0.5)).alias("offset"))
