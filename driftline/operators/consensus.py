"""The referee: evidence columns to a state and its reasons, as one CASE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States and thresholds of the verdict.
STATES = ("CONFIRMED", "LIKELY", "AMBIGUOUS", "REJECTED", "TEMPORAL_RECOVERY_CANDIDATE")
STRONG, WEAK = 2.0, 0.0
WALL_PART, SURE, STRUCTURE = 0.5, 0.7, 0.5


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def verdict(rows: DataFrame) -> DataFrame:
    """``rows`` with n_support, n_against, state and reasons (array).

    Columns: present_now, cellprob, atlas_class, atlas_wall_fraction,
    atlas_class_confidence, past_support, future_support, speed, max_speed,
    shape_plausible, structure_match. A null is no information: it neither supports
    nor opposes.
    """
    c = F.col
    wall = _yes((c("atlas_class") == "CHANNEL_WALL") & (c("atlas_wall_fraction") >= WALL_PART) & (c("atlas_class_confidence") >= SURE))
    outside = _yes((c("atlas_class") == "OUTSIDE_DEVICE") & (c("atlas_class_confidence") >= SURE))
    strong, weak = _yes(c("cellprob") >= STRONG), _yes(c("cellprob") < WEAK)
    valid = _yes(c("atlas_class") == "VALID_CELL_REGION")
    artifact = _yes((c("atlas_class") == "ARTIFACT") & (c("atlas_class_confidence") >= SURE))
    seen = _yes(c("past_support")) | _yes(c("future_support"))
    fast, odd = _yes(c("speed") > c("max_speed")), ~F.coalesce(c("shape_plausible"), F.lit(True))
    support = sum((x.cast("int") for x in (strong, valid, seen)), F.lit(0))
    against = sum((x.cast("int") for x in (weak, artifact, fast, odd)), F.lit(0))
    both, structure = _yes(c("past_support")) & _yes(c("future_support")), _yes(c("structure_match") >= STRUCTURE)
    state = (
        F.when(~c("present_now"), F.when(both & structure & ~fast, "TEMPORAL_RECOVERY_CANDIDATE").otherwise("REJECTED"))
        .when(wall | outside, "REJECTED")
        .when(against >= 1, F.when(support >= 1, "AMBIGUOUS").otherwise("REJECTED"))
        .when(support >= 2, "CONFIRMED").when(support == 1, "LIKELY").otherwise("AMBIGUOUS")
    )
    tallied = c("present_now") & ~wall & ~outside
    pairs = [
        (~c("present_now") & ~_yes(c("past_support")), "no t-1 match"), (~c("present_now") & ~_yes(c("future_support")), "no t+1 match"), (~c("present_now") & ~structure, "structures do not match"), (~c("present_now") & fast, "too fast"),
        (c("present_now") & wall, "wall"), (c("present_now") & ~wall & outside, "outside"),
        (tallied & strong, "support: strong proposal"), (tallied & weak, "against: weak proposal"), (tallied & valid, "support: valid region"), (tallied & artifact, "against: artifact"),
        (tallied & seen, "support: temporal match"), (tallied & fast, "against: speed"), (tallied & odd, "against: shape"),
    ]
    reasons = F.filter(F.array(*[F.when(x, F.lit(t)) for x, t in pairs]), lambda x: x.isNotNull())
    return rows.withColumns({"n_support": F.when(tallied, support), "n_against": F.when(tallied, against), "state": state, "reasons": reasons})


def state_counts(decided: DataFrame) -> DataFrame:
    """Objects by state, zeros too."""
    every = decided.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    return every.join(decided.groupBy("state").agg(F.count("*").alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n_objects"))


def dominant_class(votes: DataFrame, key: str = "object_id", code: str = "class_code") -> DataFrame:
    """Per object the class of most of its pixels (the lower code on ties), its share, and the share of walls (code 1)."""
    counts = votes.groupBy(key, code).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.max_by(code, F.struct("n", -F.col(code))).alias("dominant"), (F.max("n") / F.sum("n")).alias("share"), (F.sum(F.when(F.col(code) == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("wall_share"))
