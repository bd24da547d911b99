"""Key-value blocks and frame labels in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The forms of a setting and of a source frame label.
SETTING = r"^\s*([A-Za-z0-9_ .#()\-]+?)\s*=\s*(.+?)\s*$"
LABEL = r"\bt:(\d+)\s*/\s*(\d+)"


def settings(rows: DataFrame, key: str, text: str, separator: str = "\n") -> DataFrame:
    """``key = value`` entries of each text: key, name, value; of a repeated name the first counts."""
    lines = rows.select(key, F.posexplode(F.split(F.col(text), separator)).alias("pos", "line")).where(F.col("line").rlike(SETTING))
    parsed = lines.select(key, "pos", F.regexp_extract("line", SETTING, 1).alias("name"), F.regexp_extract("line", SETTING, 2).alias("value"))
    return parsed.groupBy(key, "name").agg(F.min_by("value", "pos").alias("value"))


def source_frames(labels: Column) -> Column:
    """Frame numbers of an array of labels such as ``t:42/54 - name``; null if any label has none."""
    found = F.transform(labels, lambda x: F.nullif(F.regexp_extract(F.coalesce(x, F.lit("")), LABEL, 1), F.lit("")).cast("int"))
    return F.when((F.size(labels) > 0) & F.forall(found, lambda x: x.isNotNull()), found)


def frame_total(labels: Column) -> Column:
    """The total that the last label names."""
    return F.nullif(F.regexp_extract(F.element_at(labels, -1), LABEL, 2), F.lit("")).cast("int")


def version_at_least(version: Column, least: str) -> Column:
    """Whether a version such as v1.2.0 is ``least`` or later, part by part; a part that is no number is 0."""
    parts = F.transform(F.split(F.regexp_replace(version, "^v", ""), r"\."), lambda p: F.coalesce(F.regexp_extract(p, r"^(\d+)", 1).try_cast("int"), F.lit(0)))
    want = [int(x) for x in least.removeprefix("v").split(".")]
    width = max(len(want), 3)
    padded = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.coalesce(F.get(parts, i - 1), F.lit(0)))
    return padded >= F.array(*[F.lit(x) for x in [*want, *[0] * (width - len(want))]])
