"""Audits of a run: neighbours in time, excluded samples, robustness to losses, duplicate tracks, recovered detections, counts for the manifest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import Scale
from .gaps import nearest_of, places
from .kinematics import by_track, norm

#: Frames whose objects and those that ask for them meet in one group.
BLOCK = 8


def _in_block(offsets: tuple[int, ...]):
    """For a block of frames the nearest object of each to the observations that are an offset away."""

    def run(asking: pa.Table, objects: pa.Table) -> pa.Table:
        objects = objects.sort_by("label")
        (asked, known), (have, there) = places(asking, "x", "y"), places(objects, "ox", "oy")
        from_, at = asking["frame"].to_numpy(), objects["at"].to_numpy()
        out = [(np.empty(0, dtype=int), np.empty(0, dtype=np.int32), np.empty(0, dtype=int), pa.array([], pa.float64()))]
        for frame in np.unique(at):
            here = np.flatnonzero(at == frame)
            rows = [np.flatnonzero(from_ == frame - k) for k in offsets]
            which, rows = np.repeat(np.array(offsets, dtype=np.int32), [len(r) for r in rows]), np.concatenate(rows)
            place, far = nearest_of(asked[rows], known[rows], have[here], there[here])
            out.append((rows, which, here[place], far))
        rows, which, place, far = zip(*out, strict=True)
        rows, place = pa.array(np.concatenate(rows)), pa.array(np.concatenate(place))
        return pa.table({"track_id": asking["track_id"].take(rows), "frame": asking["frame"].take(rows), "offset": pa.array(np.concatenate(which)), "label": objects["label"].take(place), "distance_px": pa.chunked_array(far)})

    return run


def temporal_candidates(obs: DataFrame, offsets: tuple[int, ...] = (-2, -1, 1, 2)) -> DataFrame:
    """For every observation and offset the nearest object of that frame (the lower label on ties): track_id, frame, offset, label, distance_px.

    Observations travel once for each block of frames that their offsets touch, and
    in a frame objects are looked up in a grid: no pairs are made.
    """
    block = lambda c: F.floor(c / BLOCK)
    asking = obs.select("track_id", "frame", F.col("x_px").cast("double").alias("x"), F.col("y_px").cast("double").alias("y"), F.explode(F.array_distinct(F.array(*[block(F.col("frame") + k) for k in offsets]))).alias("block"))
    # names that are on one side only: both come from one table, whose columns a cogroup would take for the same
    objects = obs.select(F.col("frame").alias("at"), F.col("det_label").alias("label"), F.col("x_px").cast("double").alias("ox"), F.col("y_px").cast("double").alias("oy"), block(F.col("frame")).alias("block"))
    kinds = dict(asking.dtypes) | {"label": dict(objects.dtypes)["label"]}
    return asking.groupBy("block").cogroup(objects.groupBy("block")).applyInArrow(_in_block(offsets), f"track_id {kinds['track_id']}, frame {kinds['frame']}, offset int, label {kinds['label']}, distance_px double")


def exclusions(obs: DataFrame, horizon: int = 1) -> DataFrame:
    """How many observations could be samples, and why the others could not, first reason only: one row."""
    w = by_track()
    why = F.when(F.lag("frame").over(w).isNull(), "no_history").when(F.lead("frame").over(w).isNull(), "track_end").when(F.lead("frame").over(w) > F.col("frame") + horizon, "not_seen_at_horizon").when(F.col("source") != "primary", "borrowed").otherwise("used")
    rows = obs.select(why.alias("why"))
    return rows.agg(*[F.count_if(F.col("why") == k).alias(f"n_{k}") for k in ("used", "no_history", "track_end", "not_seen_at_horizon", "borrowed")], F.count("*").alias("n_rows"))


def chance(*parts: Column) -> Column:
    """A number in [0, 1) drawn from the MD5 of the parts: the same wherever and whenever it is taken."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / 4294967296.0


def loss_robustness(obs: DataFrame, scale: Scale, rates: tuple[float, ...] = (0.05, 0.15, 0.3), trials: int = 3) -> DataFrame:
    """Error of a track's speeds when detections are lost at random: rate, n, median and 90th percentile of the absolute percentage error of its mean and its net speed, and the share of tracks left with one observation."""
    cases = F.explode(F.flatten(F.array(*[F.array(*[F.struct(F.lit(r).alias("rate"), F.lit(t).alias("trial")) for t in range(trials)]) for r in rates])))

    def speeds(rows: DataFrame, *keys: str) -> DataFrame:
        w = Window.partitionBy(*keys, "track_id").orderBy("frame")
        dt = F.col("frame") - F.lag("frame").over(w)
        step = norm(F.col("x_px") - F.lag("x_px").over(w), F.col("y_px") - F.lag("y_px").over(w)) * scale.pixel_um / (dt * scale.interval_min)
        rows = rows.withColumns({"speed": step, "x0": F.first("x_px").over(w), "y0": F.first("y_px").over(w), "f0": F.first("frame").over(w)})
        net = norm(F.col("x_px") - F.col("x0"), F.col("y_px") - F.col("y0")) * scale.pixel_um / F.nullif((F.col("frame") - F.col("f0")) * scale.interval_min, F.lit(0.0))
        return rows.withColumn("net", net).groupBy(*keys, "track_id").agg(F.avg("speed").alias("mean"), F.max_by("net", "frame").alias("net"))

    whole = speeds(obs).select("track_id", F.col("mean").alias("mean0"), F.col("net").alias("net0"))
    kept = obs.select("track_id", "frame", "x_px", "y_px", cases.alias("c")).select("track_id", "frame", "x_px", "y_px", "c.rate", "c.trial").where(chance(F.col("track_id"), F.col("frame"), F.col("trial")) >= F.col("rate"))
    both = speeds(kept, "rate", "trial").join(whole, "track_id")
    error = lambda a, b: F.abs(F.col(a) / F.nullif(F.col(b), F.lit(0.0)) - 1) * 100
    both = both.withColumns({"em": error("mean", "mean0"), "en": error("net", "net0")})
    return both.groupBy("rate").agg(F.count("*").alias("n"), *[F.percentile(c, F.lit(q)).alias(f"{name}_{tag}") for c, name in (("em", "mean"), ("en", "net")) for q, tag in ((0.5, "median"), (0.9, "p90"))], F.avg(F.col("mean").isNull().cast("double")).alias("broken"))


def duplicate_tracks(a: DataFrame, b: DataFrame, tolerance: float = 5.0, share: float = 0.5) -> DataFrame:
    """Tracks of ``a`` of whose observations a share lies within ``tolerance`` of one track of ``b``, frame by frame: a_track, b_track, share. By frame and grid cell."""
    near = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    left = a.select(F.col("track_id").alias("a_track"), "frame", F.col("x_px").alias("ax"), F.col("y_px").alias("ay")).withColumn("gx", F.explode(F.transform(near, lambda d: F.floor(F.col("ax") / tolerance) + d))).withColumn("gy", F.explode(F.transform(near, lambda d: F.floor(F.col("ay") / tolerance) + d)))
    right = b.select(F.col("track_id").alias("b_track"), "frame", F.col("x_px").alias("bx"), F.col("y_px").alias("by")).withColumns({"gx": F.floor(F.col("bx") / tolerance), "gy": F.floor(F.col("by") / tolerance)})
    hits = left.join(right, ["frame", "gx", "gy"]).where(norm(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) <= tolerance).groupBy("a_track", "b_track").agg(F.count("*").alias("hits"))
    size = a.groupBy(F.col("track_id").alias("a_track")).agg(F.count("*").alias("n"))
    return hits.join(size, "a_track").withColumn("share", F.col("hits") / F.col("n")).where(F.col("share") >= share).select("a_track", "b_track", "share")


def recovered_labels(primary: DataFrame, recovered: DataFrame) -> DataFrame:
    """``recovered`` detections (frame, key) with labels that follow the frame's own: the largest label there plus 1, 2, ... in the order of key."""
    top = primary.groupBy("frame").agg(F.max("det_label").alias("top"))
    k = F.row_number().over(Window.partitionBy("frame").orderBy("key"))
    return recovered.join(top, "frame", "left").withColumn("label", (F.coalesce("top", F.lit(0)) + k).cast("int")).drop("top")


def attribute_recovery(attempts: DataFrame, tracks: DataFrame) -> DataFrame:
    """The final track of each attempt (attempt, frame, label, before_frame, before_label, after_frame, after_label): by the detection it found, else the one before, else the one after; else null with a note."""
    out = attempts
    for k, (f, lab) in enumerate((("frame", "label"), ("before_frame", "before_label"), ("after_frame", "after_label"))):
        side = tracks.select(F.col("frame").alias(f), F.col("det_label").alias(lab), F.col("track_id").alias(f"t{k}"))
        out = out.join(side, [f, lab], "left")
    found = F.coalesce("t0", "t1", "t2")
    return out.select(*attempts.columns, found.alias("track_id"), F.when(found.isNull(), "no track holds it or its bracket").otherwise("").alias("note"))


def manifest_counts(obs: DataFrame, least: int = 2) -> DataFrame:
    """What a manifest counts: detections, those of each source, tracks, tracks long enough for a speed, frames with objects. One row."""
    per = obs.groupBy("track_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("source") == s).alias(s) for s in ("primary", "window", "permissive")])
    # frames are counted apart: a distinct count beside sums would double the shuffle
    frames = obs.select("frame").distinct().agg(F.count("*").alias("n_frames"))
    sums = per.agg(F.sum("n").alias("n_detections"), *[F.sum(s).alias(f"n_{s}") for s in ("primary", "window", "permissive")], F.count("*").alias("n_tracks"), F.count_if(F.col("n") >= least).alias("n_tracks_with_speed"))
    return sums.crossJoin(F.broadcast(frames))


def track_layer(obs: DataFrame, three_d: bool = False) -> DataFrame:
    """Rows of a viewer's track layer, ordered by track and frame; rows without a z are left out of a three-dimensional one."""
    rows = obs.where("z is not null") if three_d else obs
    cols = ["track_id", "frame", *(["z"] if three_d else []), F.col("y_px").alias("y"), F.col("x_px").alias("x")]
    return rows.select(*cols).orderBy("track_id", "frame")


def peaks(rows: DataFrame, by: str, position: str, score: str, separation: float) -> DataFrame:
    """Highest positions that keep ``separation`` from every higher one kept: greedy within a group, groups side by side.

    Only the kept neighbours on either side of a position can be too near, so each
    position costs one search among them.
    """
    import bisect

    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at, height = pdf[position].to_numpy(dtype=float), pdf[score].to_numpy(dtype=float)
        taken: list[float] = []
        kept = np.zeros(len(pdf), dtype=bool)
        for k in np.lexsort((at, -height)).tolist():
            i = bisect.bisect_left(taken, at[k])
            if (i == 0 or at[k] - taken[i - 1] >= separation) and (i == len(taken) or taken[i] - at[k] >= separation):
                taken.insert(i, at[k])
                kept[k] = True
        return pdf[kept]

    return rows.groupBy(by).applyInPandas(run, rows.schema)
