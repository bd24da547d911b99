"""Objects through slices: pair costs as columns, one matching per slice pair, components as objects."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import assign

#: The most that an accepted link costs, and the scale of distance.
MOST_COST, DISTANCE_SCALE = 0.9, 15.0
#: Slices whose objects meet the next slice's in one group, and pairs that are held at once.
SLICES, PAIRS = 8, 2_000_000
#: What a pair's cost is taken from.
PRICED = ("x", "y", "area", "shape", "min_x", "min_y", "max_x", "max_y")


def slice_cost(iou: Column, distance: Column, area0: Column, area1: Column, shape0: Column, shape1: Column) -> Column:
    """Dissimilarity of two objects on neighbouring slices."""
    return 1 - iou + distance / DISTANCE_SCALE + 0.5 * F.abs(F.log(area1 / area0)) + 0.5 * F.abs(shape1 - shape0)


def box_iou(a: str, b: str) -> Column:
    """Overlap of two boxes (prefix_min_x, ...), where masks are not at hand."""
    c = F.col
    w = F.greatest(F.lit(0.0), F.least(c(f"{a}.max_x"), c(f"{b}.max_x")) - F.greatest(c(f"{a}.min_x"), c(f"{b}.min_x")))
    h = F.greatest(F.lit(0.0), F.least(c(f"{a}.max_y"), c(f"{b}.max_y")) - F.greatest(c(f"{a}.min_y"), c(f"{b}.min_y")))
    area = lambda p: (c(f"{p}.max_x") - c(f"{p}.min_x")) * (c(f"{p}.max_y") - c(f"{p}.min_y"))
    return w * h / F.nullif(area(a) + area(b) - w * h, F.lit(0.0))


def _perhaps(a: dict[str, np.ndarray], b: dict[str, np.ndarray], most: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that may cost ``most`` or less: none of those is left out, nor any whose cost is not a number here."""
    reach = DISTANCE_SCALE * most * (1 + 1e-9)
    # the overlap of other boxes need not lie between 0 and 1, and so says nothing of the distance
    odd_a, odd_b = (~((t["min_x"] <= t["max_x"]) & (t["min_y"] <= t["max_y"])) for t in (a, b))
    found = [(np.empty(0, dtype=int),) * 2]
    strip = max(1, PAIRS // max(1, len(b["x"])))
    with np.errstate(all="ignore"):
        for k in range(0, len(a["x"]), strip):
            part = slice(k, k + strip)
            far = (np.abs(b["x"] - a["x"][part, None]) > reach) | (np.abs(b["y"] - a["y"][part, None]) > reach)
            i, j = np.nonzero(~far | odd_a[part, None] | odd_b)
            p, q = {c: v[part][i] for c, v in a.items()}, {c: v[j] for c, v in b.items()}
            wide = np.minimum(p["max_x"], q["max_x"]) - np.maximum(p["min_x"], q["min_x"])
            high = np.minimum(p["max_y"], q["max_y"]) - np.maximum(p["min_y"], q["min_y"])
            both = np.maximum(wide, 0) * np.maximum(high, 0)
            size = sum((t["max_x"] - t["min_x"]) * (t["max_y"] - t["min_y"]) for t in (p, q))
            cost = 1 - both / (size - both) + np.hypot(q["x"] - p["x"], q["y"] - p["y"]) / DISTANCE_SCALE + 0.5 * np.abs(np.log(q["area"] / p["area"])) + 0.5 * np.abs(q["shape"] - p["shape"])
            some = ~(cost > most + 1e-9 * (1 + abs(most)))
            found.append((i[some] + k, j[some]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _near_slices(most: float):
    """Pairs of a block of slices with the next ones, with all that their cost is taken from."""

    def run(below: pa.Table, above: pa.Table) -> pa.Table:
        z, up = below["z"].to_numpy(), above["b_z"].to_numpy()
        a, b = ({c: t[p + c].to_numpy() for c in PRICED} for t, p in ((below, "a_"), (above, "b_")))
        i, j = [np.empty(0, dtype=int)], [np.empty(0, dtype=int)]
        for k in np.intersect1d(z, up - 1):
            one, two = np.flatnonzero(z == k), np.flatnonzero(up - 1 == k)
            m, n = _perhaps({c: v[one] for c, v in a.items()}, {c: v[two] for c, v in b.items()}, most)
            i.append(one[m])
            j.append(two[n])
        rows, others = pa.array(np.concatenate(i)), pa.array(np.concatenate(j))
        columns = {c: below[c].take(rows) for c in ("stack", "z", "a", *[f"a_{c}" for c in PRICED])} | {c: above[c].take(others) for c in ("b", *[f"b_{c}" for c in PRICED])}
        return pa.table(columns)

    return run


def slice_pairs(objects: DataFrame, most: float = MOST_COST) -> DataFrame:
    """Pairs of objects (stack, z, label, x, y, area, shape, box) on slices z and z + 1 that cost at most ``most``: stack, z, a, b, cost.

    Objects meet by blocks of slices, as arrays: only pairs that may be cheap enough
    become rows, and these are priced as columns.
    """
    kinds = dict(objects.dtypes)
    some = objects.where(F.col("stack").isNotNull() & F.col("z").isNotNull())
    block = lambda z: F.floor(z / SLICES).alias
    priced = lambda p: [F.col(c).cast("double").alias(f"{p}{c}") for c in PRICED]
    below = some.select("stack", "z", F.col("label").alias("a"), *priced("a_"), block(F.col("z"))("block"))
    # names that are on one side only: both come from one table, whose columns a cogroup would take for the same
    above = some.select(F.col("stack").alias("b_stack"), F.col("z").alias("b_z"), F.col("label").alias("b"), *priced("b_"), block(F.col("z") - 1)("b_block"))
    numbers = lambda p: ", ".join(f"{p}{c} double" for c in PRICED)
    near = below.groupBy("stack", "block").cogroup(above.groupBy("b_stack", "b_block")).applyInArrow(_near_slices(most), f"stack {kinds['stack']}, z {kinds['z']}, a {kinds['label']}, {numbers('a_')}, b {kinds['label']}, {numbers('b_')}")
    near = near.select("stack", "z", "a", "b", *[F.struct(*[F.col(f"{p}_{c}").alias(c) for c in PRICED]).alias(f"{p}_") for p in "ab"])
    cost = slice_cost(F.coalesce(box_iou("a_", "b_"), F.lit(0.0)), F.hypot(F.col("b_.x") - F.col("a_.x"), F.col("b_.y") - F.col("a_.y")), F.col("a_.area"), F.col("b_.area"), F.col("a_.shape"), F.col("b_.shape"))
    return near.select("stack", "z", "a", "b", cost.alias("cost")).where(F.col("cost") <= most)


def link_slices(pairs: DataFrame, most: float = MOST_COST) -> DataFrame:
    """The cheapest matching of every slice pair: only pairs that could be accepted reach a worker."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        a, i = np.unique(pdf["a"], return_inverse=True)
        b, j = np.unique(pdf["b"], return_inverse=True)
        costs = np.full((len(a), len(b)), assign.FORBIDDEN)
        costs[i, j] = pdf["cost"]
        return pd.DataFrame([(key[0], key[1], a[r], b[c], costs[r, c]) for r, c in assign.match(costs, most / 2 + 1e-9)], columns=["stack", "z", "a", "b", "cost"])

    return pairs.groupBy("stack", "z").applyInPandas(run, "stack bigint, z int, a bigint, b bigint, cost double")


def missing_slices(links: DataFrame, objects: DataFrame, far: DataFrame, most: float = 0.5) -> DataFrame:
    """One-slice repairs: pairs of slices z and z + 2 (``far``: stack, z, a, b, cost) under ``most``, whose ends have no link between: stack, z + 1, a, b."""
    up = links.select("stack", F.col("z"), F.col("a"))
    down = links.select("stack", (F.col("z") + 1).alias("zb"), F.col("b"))
    ok = far.where(F.col("cost") < most).join(up, ["stack", "z", "a"], "left_anti").withColumn("zb", F.col("z") + 2).join(down, ["stack", "zb", "b"], "left_anti")
    return ok.select("stack", (F.col("z") + 1).alias("z"), "a", "b")


def overlap_link(detections: DataFrame, least: float = 0.1, most_gap: int = 2) -> DataFrame:
    """Tracks by box overlap alone: each detection takes, of those within ``most_gap`` frames before that overlap enough, the latest and best; greedy per frame.

    Movies (movie, frame, label, box) are independent groups.
    """

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame", "label"]).reset_index(drop=True)
        box = pdf[["min_x", "min_y", "max_x", "max_y"]].to_numpy(dtype=float)
        frame = pdf["frame"].to_numpy()
        track, taken, n = np.zeros(len(pdf), dtype=int), np.zeros(len(pdf), dtype=bool), 0
        at: dict[int, np.ndarray] = {int(f): np.flatnonzero(frame == f) for f in np.unique(frame)}
        for f, rows in at.items():
            open_ = list(rows)
            for dt in range(1, most_gap + 1):
                before = [i for i in at.get(f - dt, []) if not taken[i]]
                if not before or not open_:
                    continue
                lo = np.maximum(box[before][:, None, :2], box[open_][None, :, :2])
                hi = np.minimum(box[before][:, None, 2:], box[open_][None, :, 2:])
                both = np.clip(hi - lo, 0, None).prod(axis=2)
                size = lambda k: (box[k][:, 2] - box[k][:, 0]) * (box[k][:, 3] - box[k][:, 1])
                one, two = size(before)[:, None], size(open_)[None, :]
                # containment floors the overlap: a part of a body is that body
                score = np.maximum(both / np.maximum(one + two - both, 1e-9), 0.5 * both / np.maximum(np.minimum(one, two), 1e-9))
                used_a, used_b = set(), set()
                for a, b in sorted(np.argwhere(score >= least).tolist(), key=lambda p: (-score[p[0], p[1]], p)):
                    if a not in used_a and b not in used_b:
                        used_a.add(a), used_b.add(b)
                        track[open_[b]] = track[before[a]]
                        taken[before[a]] = True
                open_ = [d for k, d in enumerate(open_) if k not in used_b]
            for d in open_:
                n += 1
                track[d] = n
        return pd.DataFrame({"movie": key[0], "track_id": track, "frame": frame, "label": pdf["label"]})

    return detections.select("movie", "frame", "label", "min_x", "min_y", "max_x", "max_y").groupBy("movie").applyInPandas(run, "movie bigint, track_id int, frame int, label int")
