"""Rule-based findings: one projection per rule, united and ordered.

A finding is (severity, code, title, frame, track_id, rule_seq): rules are numbered
in the order they are stated, so equal findings keep that order.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SEVERITIES, Scale, TrackingSettings
from .kinematics import by_track

# Thresholds that decide what is found.
STATIONARY_UM, STATIONARY_MINUTES, STATIONARY_SPAN = 4.0, 30.0, 3
FAST_PART = 0.8
AMBIGUOUS_MARGIN = 2.0
SHAPE_JUMP = -2.0 * math.log(0.01)
SIZE_SIGMAS = 3.0
JUMP_OBJECTS, JUMP_PART = 2, 0.5
#: The rules in their order, with their severities.
RULES = {
    "developer_model_override": "critical", "imported_segmentation": "info", "no_pixel_size": "critical", "no_frame_interval": "critical", "no_z_step": "critical", "anisotropic_pixels": "critical",
    "multichannel_field": "info", "inferred_channel": "info", "filtered_instances": "info", "segmentation_gap": "warning", "count_jump": "warning", "merge_suspected": "warning", "split_suspected": "warning",
    "border_entry": "info", "border_exit": "info", "gap_bridged": "info", "likely_missed_detection": "warning", "long_reacquisition": "warning", "link_ambiguous": "warning", "morphology_discontinuity": "warning",
    "size_jump": "warning", "fast_track": "warning", "fragment": "info", "gap_dominated_track": "warning", "unlinked_start": "info", "fallback_dependent_track": "warning", "stationary_track": "warning", "no_tracks": "info",
}


def finding(rows: DataFrame, code: str, title: Column, frame: Column | None = None, track: Column | None = None, severity: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return rows.select(
        (severity if severity is not None else F.lit(RULES[code])).alias("severity"), F.lit(code).alias("code"), title.alias("title"),
        (frame if frame is not None else none).cast("int").alias("frame"), (track if track is not None else none).cast("bigint").alias("track_id"), F.lit(list(RULES).index(code)).alias("rule_seq"),
    )


def text(pattern: str, *cols: str) -> Column:
    return F.format_string(pattern, *[F.col(c) for c in cols])


def run_findings(spark, scale: Scale, *, ndim: int = 2, model_override: bool = False, provenance: str = "model", anisotropic: bool = False, n_lanes: int = 1, lanes_applied: bool = False, inferred_lanes: int = 0) -> DataFrame:
    """What holds of the whole run: calibration, provenance, lanes. Driver-side facts, so a table of constants."""
    facts = [
        ("developer_model_override", model_override, "A developer's model override is in use"), ("imported_segmentation", provenance != "model", f"The segmentation is imported ({provenance})"),
        ("no_pixel_size", not scale.pixel_calibrated, "No pixel size: lengths are in pixels only"), ("no_frame_interval", not scale.interval_calibrated, "No frame interval: times are in frames only"),
        ("no_z_step", ndim == 3 and scale.z_um is None, "No z step: no distances in three dimensions"), ("anisotropic_pixels", anisotropic, "Pixels are not square"),
        ("multichannel_field", lanes_applied and n_lanes > 1, f"{n_lanes} lanes: links across lanes are refused"), ("inferred_channel", inferred_lanes > 0, f"{inferred_lanes} lane(s) inferred, not seen"),
    ]
    rows = [(RULES[c], c, title, None, None, list(RULES).index(c)) for c, holds, title in facts if holds]
    return spark.createDataFrame(rows, "severity string, code string, title string, frame int, track_id bigint, rule_seq int")


def filtered_instances(diagnostics: DataFrame) -> DataFrame:
    """Frames (frame, removed) where the size filter removed objects."""
    return finding(diagnostics.where("removed > 0"), "filtered_instances", text("%d small object(s) removed", "removed"), F.col("frame"))


def segmentation_gap(counts: DataFrame) -> DataFrame:
    """Frames (frame, n_objects) without objects, between frames with some."""
    # two numbers of the whole movie decide, so no window over all frames is needed
    ends = counts.where("n_objects > 0").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    rows = counts.where("n_objects = 0").join(F.broadcast(ends), (F.col("frame") > F.col("first")) & (F.col("frame") < F.col("last")))
    return finding(rows, "segmentation_gap", F.lit("No cells found in a frame between detections"), F.col("frame"))


def count_jump(counts: DataFrame) -> DataFrame:
    """Consecutive frames whose counts differ by 2 or more and by half of the earlier one."""
    before = counts.select((F.col("frame") + 1).alias("frame"), F.col("n_objects").alias("n_before"))
    change = F.abs(F.col("n_objects") - F.col("n_before"))
    rows = counts.join(before, "frame").where((change >= JUMP_OBJECTS) & (change >= JUMP_PART * F.col("n_before")))
    return finding(rows, "count_jump", text("Object count jumps from %d to %d at frame %d", "n_before", "n_objects", "frame"), F.col("frame"))


def suspected(events: DataFrame, what: str) -> DataFrame:
    """``merge`` or ``split``: one finding per track listed in a frame's event row (frame, <what>_suspected array)."""
    rows = events.select("frame", F.explode(f"{what}_suspected").alias("track_id"))
    title = {"merge": "Track %d may have merged with another cell", "split": "Track %d may be part of a split mask"}[what]
    return finding(rows, f"{what}_suspected", text(title, "track_id"), F.col("frame"), F.col("track_id"))


def border_flags(flagged: DataFrame) -> DataFrame:
    """Tracks (track_id, first_frame, last_frame, enters, exits) that begin or end on a mask cut by the edge."""
    a = finding(flagged.where("enters"), "border_entry", text("Track %d enters at the image border", "track_id"), F.col("first_frame"), F.col("track_id"))
    return a.unionByName(finding(flagged.where("exits"), "border_exit", text("Track %d leaves at the image border", "track_id"), F.col("last_frame"), F.col("track_id")))


def links(obs: DataFrame) -> DataFrame:
    """Each observation with the one before: prev_frame, gap, prev_area."""
    w = by_track()
    return obs.withColumns({"prev_frame": F.lag("frame").over(w), "prev_area": F.lag("area_px").over(w)}).withColumn("gap", F.col("frame") - F.col("prev_frame")).withColumn("missing", F.col("gap") - 1).where("prev_frame is not null")


def gap_bridged(link: DataFrame) -> DataFrame:
    return finding(link.where("gap > 1"), "gap_bridged", text("Track %d reacquired after %d missing frame(s)", "track_id", "missing"), F.col("frame"), F.col("track_id"))


def likely_missed_detection(link: DataFrame) -> DataFrame:
    rows = link.where("gap = 2").withColumn("at", F.col("prev_frame") + 1)
    return finding(rows, "likely_missed_detection", text("Frame %d is a likely missed detection", "at"), F.col("at"), F.col("track_id"))


def long_reacquisition(link: DataFrame) -> DataFrame:
    return finding(link.where("gap > 2"), "long_reacquisition", text("Track %d was reacquired after %d missing frames", "track_id", "missing"), F.col("frame"), F.col("track_id"))


def link_ambiguous(link: DataFrame) -> DataFrame:
    """Links (with link_margin) whose next best explanation is within 2 chi-square."""
    return finding(link.where(F.col("link_margin") < AMBIGUOUS_MARGIN), "link_ambiguous", text("Track %d's link into frame %d is ambiguous", "track_id", "frame"), F.col("frame"), F.col("track_id"))


def shape_jump(aspect0: Column, aspect1: Column, solidity0: Column, solidity1: Column, settings: TrackingSettings = TrackingSettings()) -> Column:
    """Change of shape in squared sigmas; a term without its values counts nothing, null without either."""
    ok = (aspect0 > 0) & (aspect1 > 0)
    a = F.when(ok, F.pow(F.log(aspect1 / aspect0) / settings.sigma_ln_aspect, 2))
    s = F.pow((solidity1 - solidity0) / settings.sigma_solidity, 2)
    return F.when(a.isNotNull() | s.isNotNull(), F.coalesce(a, F.lit(0.0)) + F.coalesce(s, F.lit(0.0)))


def morphology_discontinuity(obs: DataFrame, settings: TrackingSettings = TrackingSettings()) -> DataFrame:
    """Consecutive observations (with aspect, solidity) beyond the 0.99 quantile of the assumed shape noise."""
    w = by_track()
    jump = shape_jump(F.lag("aspect").over(w), F.col("aspect"), F.lag("solidity").over(w), F.col("solidity"), settings)
    rows = obs.withColumn("jump", jump).withColumn("k", F.row_number().over(w)).where((F.col("k") > 1) & (F.col("jump") > SHAPE_JUMP))
    return finding(rows, "morphology_discontinuity", text("Track %d changes shape abruptly at frame %d", "track_id", "frame"), F.col("frame"), F.col("track_id"))


def size_jump(link: DataFrame, settings: TrackingSettings = TrackingSettings()) -> DataFrame:
    """Links whose sizes are further apart than three sigmas of the tracker's own size noise."""
    bound = math.exp(SIZE_SIGMAS * settings.sigma_ln_area)
    ratio = F.col("area_px") / F.col("prev_area")
    rows = link.where((F.col("prev_area") > 0) & (F.col("area_px") > 0) & ((ratio > bound) | (ratio < 1.0 / bound)))
    return finding(rows, "size_jump", text("Track %d's area changes sharply at frame %d", "track_id", "frame"), F.col("frame"), F.col("track_id"))


def fast_track(summary: DataFrame, settings: TrackingSettings = TrackingSettings()) -> DataFrame:
    """Tracks whose fastest step is above 0.8 of the speed gate; none and zero speeds are passed over."""
    return finding(summary.where(F.col("max_speed_um_per_min") > FAST_PART * settings.max_speed_um_per_min), "fast_track", text("Track %d moves close to the speed limit", "track_id"), F.col("last_frame"), F.col("track_id"))


def fragment(summary: DataFrame) -> DataFrame:
    return finding(summary.where(F.col("flags").contains("fragment")), "fragment", text("Track %d has only %d observation(s)", "track_id", "n_observations"), F.col("first_frame"), F.col("track_id"))


def gap_dominated(summary: DataFrame) -> DataFrame:
    rows = summary.where((F.col("total_missing_frames") > 0) & (F.col("total_missing_frames") >= F.col("n_observations")))
    return finding(rows, "gap_dominated_track", text("Track %d is missing more often than it is seen", "track_id"), F.col("first_frame"), F.col("track_id"))


def unlinked_start(starts: DataFrame, settings: TrackingSettings = TrackingSettings()) -> DataFrame:
    """Starts that an earlier track could explain; a warning if only the gap forbade a pairing of good fit (cost_chi2, if there is one)."""
    fits = (F.col("refused_because") == "gap_too_long") & (F.col("cost_chi2") <= settings.gate) if "cost_chi2" in starts.columns else F.lit(False)
    severity = F.when(fits, "warning").otherwise("info")
    return finding(starts.where("candidate_track_id is not null"), "unlinked_start", text("Track %d starts at frame %d and was not joined to track %d", "track_id", "frame", "candidate_track_id"), F.col("frame"), F.col("track_id"), severity)


def fallback_dependent(summary: DataFrame, settings: TrackingSettings = TrackingSettings()) -> DataFrame:
    rows = summary.where((F.col("n_observations") >= settings.min_observations) & (F.col("n_borrowed") > 0) & (F.col("n_borrowed") * 2 >= F.col("n_observations")))
    return finding(rows, "fallback_dependent_track", text("Track %d depends on the extra detection passes", "track_id"), F.col("first_frame"), F.col("track_id"))


def stationary(summary: DataFrame, settings: TrackingSettings = TrackingSettings()) -> DataFrame:
    """Tracks that end within 4 um of their start after half an hour; in frames, where there is no time."""
    long = F.when(F.col("duration_min").isNotNull(), F.col("duration_min") >= STATIONARY_MINUTES).otherwise(F.col("span_frames") >= STATIONARY_SPAN)
    rows = summary.where((F.col("n_observations") >= settings.min_observations) & (F.col("net_displacement_um") < STATIONARY_UM) & long)
    return finding(rows, "stationary_track", text("Track %d barely moves", "track_id"), F.col("first_frame"), F.col("track_id"))


def no_tracks(summary: DataFrame) -> DataFrame:
    return finding(summary.agg(F.count("*").alias("n")).where("n = 0"), "no_tracks", F.lit("No trajectories in this dataset"))


def united(parts: list[DataFrame]) -> DataFrame:
    """All findings with ``position``, their place in the order severity, frame (none first), rule, track.

    The order is over findings, not over data; a sort by range gives it on any number
    of them, and the place is left to the caller who needs it.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return every.withColumn("severity_rank", rank.cast("int")).orderBy("severity_rank", F.coalesce("frame", F.lit(-1)), "rule_seq", "track_id")


def severity_counts(findings: DataFrame) -> DataFrame:
    """Findings by severity, zeros too."""
    every = findings.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    return every.join(findings.groupBy("severity").agg(F.count("*").alias("n")), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n_findings"))


def hard_frames(counts: DataFrame, frame_gaps: DataFrame) -> DataFrame:
    """Frames by how much they need review: 3 for a zero between objects, 1 per gap, 0.5 per object of the jump from the neighbours' mean."""
    w = Window.orderBy("frame")
    rows = counts.join(frame_gaps, "frame", "left").withColumn("n_gaps", F.coalesce("n_gaps", F.lit(0)))
    before, after = F.lag("n_objects").over(w), F.lead("n_objects").over(w)
    mean = F.when(before.isNull(), after).when(after.isNull(), before).otherwise((before + after) / 2)
    zero = ((F.col("n_objects") == 0) & (F.least(before, after) > 0) & before.isNotNull() & after.isNotNull()).cast("int")
    rows = rows.withColumns({"zero_between": F.coalesce(zero, F.lit(0)), "jump": F.coalesce(F.abs(F.col("n_objects") - mean), F.lit(0.0)).cast("double")})
    return rows.withColumn("score", 3.0 * F.col("zero_between") + F.col("n_gaps") + 0.5 * F.col("jump"))
