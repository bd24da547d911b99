"""Movies, fields and their evidence: partners within a radius, overlaps between movies, distinct fields, the unit of a split; and row-wise fallbacks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import Scale
from .kinematics import norm

#: Labels of stored states; what names an unknown; shapes that a track's row takes over from its detection.
STATUS_LABELS = {"complete": "Analysed", "failed": "Failed", "cancelled": "Stopped"}
UNRESOLVED = "unknown:"
MORPHOLOGY = ("perimeter_px", "major_axis_px", "minor_axis_px", "aspect_ratio", "eccentricity", "orientation_rad", "circularity", "solidity", "extent_fraction", "mean_intensity", "volume_vox", "sphericity", "elongation", "flatness")
DISTINCT = ("different regions", "different acquisitions")


def with_morphology(tracks: DataFrame, detections: DataFrame, scale: Scale) -> DataFrame:
    """``tracks`` (frame, det_label) with the shape columns of their detections (frame, label), and lengths and volumes in micrometres where calibrated.

    A column that the detections lack, or a value that is not finite, is null.
    """
    have = dict(detections.dtypes)

    def finite(c: str) -> Column:
        value = F.col(c).cast("double") if c in have else F.lit(None).cast("double")
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value).alias(c)

    side = detections.select("frame", F.col("label").alias("det_label"), *[finite(c) for c in MORPHOLOGY])
    um = scale.pixel_um if scale.pixel_calibrated else None
    voxel = um * um * scale.z_um if um is not None and scale.z_um is not None else None
    physical = {f"{c}_um": F.col(f"{c}_px") * F.lit(um) for c in ("perimeter", "major_axis", "minor_axis")} | {"volume_um3": F.col("volume_vox") * F.lit(voxel)}
    return tracks.join(side, ["frame", "det_label"], "left").withColumns({k: v.cast("double") for k, v in physical.items()})


def status_label(status: Column) -> Column:
    """How a stored state is shown; one without a label shows itself."""
    named = F.create_map(*[F.lit(x) for kv in STATUS_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(named, status), status)


def first_present(*values: Column) -> Column:
    """The first value that is neither null nor an empty text."""
    return F.coalesce(*[F.when(v.cast("string") != "", v) for v in values])


def per_hour(hourly: Column, by_minute: Column) -> Column:
    """A rate an hour, or 60 times the one a minute where only that is known; what is not finite counts as unknown."""
    known = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    return F.coalesce(known(hourly), known(by_minute) * 60.0)


def radius_partners(before: DataFrame, after: DataFrame, by: str, radius: float) -> DataFrame:
    """Pairs (``by``, a, b, distance_px) of points (``by``, key, x, y) within ``radius`` of each other, each the other's only one. Points meet by grid cell."""
    near = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    left = before.select(by, F.col("key").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    left = left.withColumn("gx", F.explode(F.transform(near, lambda d: F.floor(F.col("ax") / radius) + d))).withColumn("gy", F.explode(F.transform(near, lambda d: F.floor(F.col("ay") / radius) + d)))
    right = after.select(by, F.col("key").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by_")).withColumns({"gx": F.floor(F.col("bx") / radius), "gy": F.floor(F.col("by_") / radius)})
    met = left.join(right, [by, "gx", "gy"]).withColumn("distance_px", norm(F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay"))).where(F.col("distance_px") <= radius)
    # one aggregation on either side says who is alone; the pair that is left is its own minimum
    ones = met.groupBy(by, "a").agg(F.count("*").alias("n"), F.min("b").alias("b"), F.min("distance_px").alias("distance_px")).where("n = 1").drop("n")
    others = met.groupBy(by, "b").agg(F.count("*").alias("n")).where("n = 1").select(by, "b")
    return ones.join(others, [by, "b"], "left_semi").select(by, "a", "b", "distance_px")


def majority(rows: DataFrame, by: str, value: str, known: Column) -> DataFrame:
    """The most frequent known value of each group, the least one on ties; no row for a group without any."""
    counts = rows.where(known).groupBy(by, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("best"))
    return best.select(by, F.col("best.v").alias(value))


def united(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all parts with the columns of any, null where a part lacks them."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def rolling_median(rows: DataFrame, by: str, order: str, value: str, width: int) -> DataFrame:
    """``rows`` with ``rolling_median``, that of an odd number of rows around each; beyond the ends of a group its end values count on."""
    if width % 2 == 0:
        raise ValueError("the window must be odd")
    half = width // 2
    w = Window.partitionBy(by).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at, n = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy(by))
    before, after = F.greatest(half - at + 1, F.lit(0)).cast("int"), F.greatest(half - (n - at), F.lit(0)).cast("int")
    around = F.concat(F.collect_list(value).over(w.rowsBetween(-half, half)), F.array_repeat(F.first(value).over(whole), before), F.array_repeat(F.last(value).over(whole), after))
    return rows.withColumn("rolling_median", F.element_at(F.array_sort(around), half + 1))


def overlap_evidence(frames: DataFrame) -> DataFrame:
    """What the pixels say about every two movies of one acquisition: a, b, shared_frames, checked_frames, verdict.

    ``frames`` has movie, acquisition, source_frame and content (a digest of the
    pixels; null without an image). Only frames of one instant can be compared: the
    first, the middle and the last that both have. Movies of different resolved
    acquisitions show different dishes and get no row.
    """
    movies = frames.groupBy("movie", "acquisition").agg(F.count("content").alias("images"), F.count("source_frame").alias("numbered"))
    two = movies.alias("p").join(movies.alias("q"), (F.col("p.acquisition") == F.col("q.acquisition")) & (F.col("p.movie") < F.col("q.movie")))
    two = two.select(F.col("p.acquisition").alias("acquisition"), F.col("p.movie").alias("a"), F.col("q.movie").alias("b"), F.least("p.images", "q.images").alias("images"), F.least("p.numbered", "q.numbered").alias("numbered"))
    one = frames.where("source_frame is not null and content is not null").select("acquisition", "movie", "source_frame", "content")
    shared = one.alias("p").join(one.alias("q"), (F.col("p.acquisition") == F.col("q.acquisition")) & (F.col("p.source_frame") == F.col("q.source_frame")) & (F.col("p.movie") < F.col("q.movie")))
    shared = shared.select(F.col("p.movie").alias("a"), F.col("q.movie").alias("b"), F.col("p.source_frame").alias("source_frame"), (F.col("p.content") == F.col("q.content")).alias("same"))
    w = Window.partitionBy("a", "b")
    ranked = shared.withColumns({"k": F.row_number().over(w.orderBy("source_frame")), "n": F.count(F.lit(1)).over(w)})
    checked = ranked.where((F.col("k") == 1) | (F.col("k") == F.col("n")) | (F.col("k") == F.floor(F.col("n") / 2) + 1))
    checked = checked.groupBy("a", "b").agg(F.first("n").alias("shared_frames"), F.count("*").alias("checked_frames"), F.min(F.col("same").cast("int")).alias("same"))
    verdict = F.when(F.col("images") == 0, "not checked: no image").when(F.col("numbered") == 0, "not checked: no source frame numbers").when(F.col("same").isNull(), "undecidable: no shared instant").when(F.col("same") == 1, "same pixels").otherwise("different regions")
    return two.join(checked, ["a", "b"], "left").select("a", "b", F.coalesce("shared_frames", F.lit(0)).alias("shared_frames"), F.coalesce("checked_frames", F.lit(0)).alias("checked_frames"), verdict.alias("verdict"))


def distinct_fields(sizes: dict[str, int], verdicts: dict[tuple[str, str], str]) -> list[str]:
    """Fields that are proven pairwise distinct, taken by size: each only if the evidence sets it apart from all taken before. Fields without evidence are not proven."""
    apart = {frozenset(pair) for pair, v in verdicts.items() if v in DISTINCT} - {frozenset(pair) for pair, v in verdicts.items() if v not in DISTINCT}
    taken: list[str] = []
    for field in sorted(sizes, key=lambda f: (-sizes[f], f)):
        if all(frozenset((field, other)) in apart for other in taken):
            taken.append(field)
    return taken


def outer_unit(rows: DataFrame, acquisition: str = "acquisition") -> tuple[str, str]:
    """What a split may hold out, and why: acquisitions, if there are two or more and all are known, else fields."""
    ids = rows.select(F.col(acquisition).cast("string").alias("id")).distinct()
    n, unknown = ids.agg(F.count("*"), F.count_if(F.col("id").isNull() | F.col("id").startswith(UNRESOLVED))).first()
    if unknown:
        return "field", f"{unknown} of {n} acquisitions unknown"
    return ("acquisition", f"{n} acquisitions") if n > 1 else ("field", f"{n} acquisition(s): fields are the strongest split")
