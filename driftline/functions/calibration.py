"""Which source of a calibration counts: the first in order that is positive, with where it came from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import Scale, positive


def first_positive(candidates: Sequence[tuple[str, Column]]) -> Column:
    """A struct (value, source) of the first candidate that is a positive, finite number; null values if none is."""
    choice = F.lit(None).cast("struct<value:double,source:string>")
    for name, c in reversed(candidates):
        ok = c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < float("inf"))
        choice = F.when(ok, F.struct(c.cast("double").alias("value"), F.lit(name).alias("source"))).otherwise(choice)
    return choice


def pixel_size(override: Column, file: Column, document: Column, tag: Column) -> Column:
    """A user's own value, then the acquisition file's, the embedded document's and the tag's."""
    return first_positive([("user", override), ("file", file), ("document", document), ("tag", tag)])


def frame_interval(override: Column, measured: Column, header: Column, document: Column, nominal: Column) -> Column:
    """A user's own value, then the measured mean, the header's, the document's and the nominal one."""
    return first_positive([("user", override), ("measured", measured), ("header", header), ("document", document), ("nominal", nominal)])


def resolved(user: dict, file: dict) -> tuple[Scale, dict[str, str]]:
    """A run's scale (pixel_um, interval_min, z_um) and where each value comes from: the user's own, if it is a positive number, else the file's, else none."""
    values, origin = {}, {}
    for name in ("pixel_um", "interval_min", "z_um"):
        told = next(((v, k) for k, v in (("user", user.get(name)), ("file", file.get(name))) if positive(v)), (None, "none"))
        values[name], origin[name] = told
    return Scale.of(**values), origin
