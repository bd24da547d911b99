"""Pairs of vectors by cosine, within a block that both share, in groups of a stated size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block that meet in one group, about; and of these, rows of products that are held at once.
PART, STRIP = 2048, 512
#: How far products of matrices may be from sums in the order of the components, and the norms for which that holds.
SLACK, NORMS = 1e-9, (1e-100, 1e100)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed in the order of the components."""
    out = np.zeros(len(a))
    with np.errstate(invalid="ignore", over="ignore"):
        for k in range(a.shape[1]):
            out = out + a[:, k] * b[:, k]
    return out


def _pairs(rows: pa.Table, least: float) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a group (block, i, j) in order of ids, and its pairs of vectors whose parts are i and j: places x, y and cosines."""
    rows = rows.sort_by("id")
    width = rows["size"][0].as_py()
    v = rows["v"].combine_chunks().flatten().to_numpy().reshape(-1, width).astype(float)
    ids, part, i, j = rows["id"].to_numpy(), rows["part"].to_numpy(), rows["i"][0].as_py(), rows["j"][0].as_py()
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        norm = np.sqrt(_products(v, v))
        even = (norm > NORMS[0]) & (norm < NORMS[1])
        unit = np.where(even[:, None], v / norm[:, None], 0.0)
    found = [(np.empty(0, dtype=int),) * 2 + (np.empty(0),)]
    left, right = np.flatnonzero((part == i) & (norm != 0)), np.flatnonzero((part == j) & (norm != 0))
    for k in range(0, len(left), STRIP):
        strip = left[k : k + STRIP]
        # matrices find what could be near enough; odd vectors meet all others
        near = (unit[strip] @ unit[right].T >= least - SLACK) | ~even[strip][:, None] | ~even[right][None, :]
        x, y = np.nonzero(near)
        x, y = strip[x], right[y]
        if i == j:
            x, y = x[x < y], y[x < y]
        x, y = np.minimum(x, y), np.maximum(x, y)
        with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
            both = norm[x] * norm[y]
            cos = _products(v[x], v[y]) / both
            # not a number counts as the greatest, as in SQL
            ok = (ids[x] < ids[y]) & (both != 0) & ((cos >= least) | np.isnan(cos))
        found.append((x[ok], y[ok], cos[ok]))
    return rows, *(np.concatenate(c) for c in zip(*found, strict=True))


def _named(rows: pa.Table, x: np.ndarray, y: np.ndarray, cos: np.ndarray) -> dict[str, pa.Array]:
    return {"block": rows["block"].take(pa.array(x)), "a": rows["id"].take(pa.array(x)), "b": rows["id"].take(pa.array(y)), "cosine": pa.array(cos)}


def _tile(least: float):
    """Pairs of a group."""

    def run(rows: pa.Table) -> pa.Table:
        return pa.table(_named(*_pairs(rows, least)))

    return run


def _nearest_in_tile(least: float):
    """Of a group's pairs the best one of each vector: id, partner, cosine."""

    def run(rows: pa.Table) -> pa.Table:
        rows, x, y, cos = _pairs(rows, least)
        own, other, cos = np.r_[x, y], np.r_[y, x], np.r_[cos, cos]
        # the greatest cosine (not a number before all), then the lowest id; rows are in order of ids
        odd = np.isnan(cos)
        order = np.lexsort((other, -np.where(odd, 0.0, cos), ~odd, own))
        own = own[order]
        best = np.append(True, own[1:] != own[:-1])[: len(own)]
        order, own = order[best], own[best]
        return pa.table({"id": rows["id"].take(pa.array(own)), "partner": rows["id"].take(pa.array(other[order])), "cosine": pa.array(cos[order])})

    return run


def _only_in_tile(least: float):
    """How many pairs each vector has in a group, and one of them: __id, __n, block, a, b, cosine."""

    def run(rows: pa.Table) -> pa.Table:
        rows, x, y, cos = _pairs(rows, least)
        own, first, n = np.unique(np.r_[x, y], return_index=True, return_counts=True)
        k = first % max(1, len(x))
        return pa.table({"__id": rows["id"].take(pa.array(own)), "__n": pa.array(n.astype(np.int64)), **_named(rows, x[k], y[k], cos[k])})

    return run


def cosine_pairs(rows: DataFrame, block: str, least: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Pairs a < b of the same block with a cosine of ``least`` or more.

    Only vectors that share a block meet, and all of these do: a block is dealt into
    parts, and every two parts are a group, whose products are taken as matrices.
    What may be near enough is then summed in the order of the components, so
    results do not depend on how vectors are dealt. Norms are taken once per vector
    and group, not per pair.
    """
    tiles, kinds = _tiles(rows, block, key, vector)
    return tiles.applyInArrow(_tile(least), f"block {kinds['block']}, a {kinds['id']}, b {kinds['id']}, cosine double")


def _tiles(rows: DataFrame, block: str, key: str, vector: str):
    """Vectors grouped by block, size and two parts, and the types of their columns."""
    v = rows.select(F.col(key).alias("id"), F.col(block).alias("block"), F.col(vector).alias("v")).where("id is not null and block is not null and v is not null and not exists(v, x -> x is null)")
    v = v.withColumn("size", F.size("v")).where("size > 0")
    n = v.groupBy("block").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(1, -(-n // PART))
    v = v.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    dealt = v.withColumn("other", other).withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("other")
    return dealt.groupBy("block", "size", "i", "j"), dict(v.dtypes)


def nearest_pairs(rows: DataFrame, block: str, least: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``nearest`` of ``cosine_pairs``: a group sends on each vector's best pair, not all pairs."""
    tiles, kinds = _tiles(rows, block, key, vector)
    best = tiles.applyInArrow(_nearest_in_tile(least), f"id {kinds['id']}, partner {kinds['id']}, cosine double")
    return best.groupBy("id").agg(F.max_by("partner", F.struct("cosine", -F.col("partner"))).alias("partner"), F.max("cosine").alias("cosine"))


def mutual_unique_pairs(rows: DataFrame, block: str, least: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``mutual_unique`` of ``cosine_pairs``: a group sends on how many pairs each vector has and one of them, not all pairs."""
    tiles, kinds = _tiles(rows, block, key, vector)
    pair = ("block", "a", "b", "cosine")
    some = tiles.applyInArrow(_only_in_tile(least), f"__id {kinds['id']}, __n bigint, block {kinds['block']}, a {kinds['id']}, b {kinds['id']}, cosine double")
    only = some.groupBy("__id").agg(F.sum("__n").alias("__n"), *[F.min(c).alias(c) for c in pair]).where("__n = 1")
    return only.groupBy(*pair).agg(F.count("*").alias("__n")).where("__n = 2").drop("__n")


def nearest(pairs: DataFrame) -> DataFrame:
    """For every id of symmetric ``pairs`` its partner of the greatest cosine (the lower id on ties)."""
    ends = F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("partner")), F.struct(F.col("b").alias("id"), F.col("a").alias("partner")))
    both = pairs.select("cosine", F.inline(ends))
    return both.groupBy("id").agg(F.max_by("partner", F.struct("cosine", -F.col("partner"))).alias("partner"), F.max("cosine").alias("cosine"))


def mutual_unique(pairs: DataFrame) -> DataFrame:
    """Pairs in which each side has no other partner: those that both of their ends have as the only one. Pairs are made once."""
    ends = pairs.select("*", F.explode(F.array("a", "b")).alias("__id"))
    only = ends.groupBy("__id").agg(F.count("*").alias("__n"), *[F.min(c).alias(c) for c in pairs.columns]).where("__n = 1")
    return only.groupBy(*pairs.columns).agg(F.count("*").alias("__n")).where("__n = 2").drop("__n")


def centroids(rows: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """Mean, population and sample variance of every component per group: by, k, n, mean, var_pop, var_samp."""
    x = F.col("x").cast("double")
    return rows.select(by, F.posexplode(vector).alias("k", "x")).groupBy(by, "k").agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var_pop"), F.var_samp(x).alias("var_samp"))


def top_by(rows: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group in the given order."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= n)
