"""Two-sided as-of joins: the nearest labelled moment before and after each moment of a sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def brackets(rows: DataFrame, key: str, time: str, labelled: Column, longest: float | None = None, ordered: Column | None = None, evidence: Column | None = None) -> DataFrame:
    """``rows`` with before, after (labelled times around), fraction (share of the time elapsed), ok and why not.

    Reasons come in their order: a sequence that is not in true time order
    (``ordered`` false or null), no labelled time before or after, a bracket of more
    than ``longest``, nothing to test (``evidence`` false or null). One window per
    direction over the sequence's own key: no self-join.
    """
    w = Window.partitionBy(key).orderBy(time)
    mark = F.when(labelled, F.col(time))
    out = rows.withColumns({
        "before": F.last(mark, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, -1)),
        "after": F.first(mark, ignorenulls=True).over(w.rangeBetween(1, Window.unboundedFollowing)),
    })
    span = F.col("after") - F.col("before")
    why = F.when(F.lit(False) if ordered is None else ~F.coalesce(ordered, F.lit(False)), "no true time order").when(F.col("before").isNull(), "first labelled time").when(F.col("after").isNull(), "last labelled time")
    if longest is not None:
        why = why.when(span > longest, "bracket too long")
    if evidence is not None:
        why = why.when(~F.coalesce(evidence, F.lit(False)), "nothing to test")
    why = why.otherwise("")
    return out.withColumn("fraction", (F.col(time) - F.col("before")).cast("double") / span).withColumn("why", why).withColumn("ok", F.col("why") == "")
