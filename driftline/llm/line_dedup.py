"""Cross-site boilerplate lines: distinct-site spread by HyperLogLog, exact near the threshold.

Built-in functions only. A line's key is the MD5 of the line without blanks at
its ends. Sites of a line are counted by a HyperLogLog sketch per line hash, which
partial aggregation merges; only lines whose estimate lies near the threshold get
an exact distinct count. A line seen on ``min_sites`` sites or more is boilerplate
and goes from every document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import columns_as, materialise

#: HyperLogLog's relative standard error is about 1.04 / sqrt(2 ** LG_K); the sketch is exact for small counts.
LG_K = 10
#: Standard errors on either side of the threshold within which counts are taken exactly.
SIGMAS = 6
#: Blanks that do not count at the ends of a line.
BLANKS = " \t\r"


def _lines(docs: DataFrame) -> DataFrame:
    lines = docs.select("row", "row2", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.trim(F.col("line"), F.lit(BLANKS))).where("line <> ''")
    return lines.select("row", "row2", "site", "pos", F.unhex(F.md5("line")).alias("key"))


def boilerplate_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """Keys of ``lines`` (key, site) that at least ``min_sites`` distinct non-null sites have: columns key, n_sites.

    n_sites is exact near the threshold and an estimate well above it.
    """
    error = SIGMAS * 1.04 / 2 ** (LG_K / 2)
    low, high = (min_sites - 1) / (1 + error), min_sites / (1 - error)
    spread = lines.groupBy("key").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    spread = spread.select("key", F.hll_sketch_estimate("sketch").alias("n_sites")).where(F.col("n_sites") >= int(low))
    spread = materialise(spread, "line_spread")
    sure = spread.where(F.col("n_sites") > high)
    near = spread.where(F.col("n_sites") <= high).select("key")
    pairs = lines.where("site is not null").join(near, "key", "left_semi").groupBy("key", "site").agg(F.lit(1).alias("one"))
    exact = pairs.groupBy("key").agg(F.count("one").alias("n_sites")).where(F.col("n_sites") >= min_sites)
    return sure.unionByName(exact)


def drop_boilerplate(docs: DataFrame, min_sites: int = 5, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """Whole documents without their boilerplate lines: id, n_lines, n_removed, text.

    Blank lines are never boilerplate. A null text stays null with 0 lines; an empty
    text is one blank line. A null site counts as none. Rows with the same id, null
    or repeated, are cleaned each by itself, for rows are told apart by 128 bits of
    hashes of id, site and text (rows equal in all three are cleaned alike). A line that a
    single site repeats, however often, stays. An empty table gives an empty result.
    """
    docs = columns_as(docs, id=id_col, text=text_col, site=site_col)
    docs = docs.withColumns({"row": F.xxhash64("id", "site", "text"), "row2": F.xxhash64(F.lit(2), "text", "site", "id")})
    lines = _lines(docs)
    keys = materialise(boilerplate_lines(lines, min_sites).select("key"), "boilerplate")
    # Only positions travel, not lines; copies of a row have the same positions.
    removed = lines.join(keys, "key", "left_semi").groupBy("row", "row2").agg(F.collect_set("pos").alias("removed"))
    # texts travel as their lines, which are split once
    split = docs.select("id", "row", "row2", F.split("text", "\n").alias("split"))
    n_lines = F.coalesce(F.size("split"), F.lit(0))
    # a difference of sets of places, so the work is in proportion to the lines
    left = F.array_except(F.sequence(F.lit(0), F.size("split") - 1), "removed")
    kept = F.when(F.col("removed").isNull(), F.col("split")).otherwise(F.transform(left, lambda i: F.get("split", i)))
    return split.join(removed, ["row", "row2"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("split").isNull(), 0).otherwise(n_lines).cast("bigint").alias("n_lines"),
        F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("bigint").alias("n_removed"),
        F.array_join(kept, "\n").alias("text"),
    )


SQL = """
WITH line AS (
  SELECT doc_id, source, unnest(generate_series(1, len(l))) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)
), spread AS (
  SELECT trim(line, ' ' || chr(9) || chr(13)) AS key FROM line
  WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
  GROUP BY 1 HAVING count(DISTINCT source) >= 5
), marked AS (
  SELECT l.doc_id, l.pos, l.line, s.key IS NOT NULL AS gone
  FROM line l LEFT JOIN spread s ON s.key = trim(l.line, ' ' || chr(9) || chr(13))
), done AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE done.text END AS text
FROM documents d LEFT JOIN done USING (doc_id)
"""
