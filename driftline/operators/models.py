"""Models on feature tables, fitted from sums: ridge, elastic net, principal axes, logistic by Newton steps, and leave-one-group-out scores.

Sums are taken by Spark over any number of rows; only matrices of the features' size
reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Linear:
    features: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float

    def column(self) -> Column:
        """The prediction as an expression: scoring stays in the plan."""
        return sum((F.col(c) * w for c, w in zip(self.features, self.weights, strict=True)), F.lit(self.intercept))

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.column()))


def _products(features: tuple[str, ...], y: str, weight: Column | None = None) -> list[Column]:
    """Sums whose values are X'WX (upper triangle), X'Wy and y'Wy of the features and a constant."""
    cols = [*[F.col(c).cast("double") for c in features], F.lit(1.0)]
    w, target = weight if weight is not None else F.lit(1.0), F.col(y).cast("double")
    return [F.sum(w * cols[i] * cols[j]) for i in range(len(cols)) for j in range(i, len(cols))] + [F.sum(w * c * target) for c in cols] + [F.sum(w * target * target)]


def _matrices(values, n: int) -> tuple[np.ndarray, np.ndarray]:
    got = np.array([0.0 if v is None else float(v) for v in values])
    xx = np.zeros((n, n))
    xx[np.triu_indices(n)] = got[: n * (n + 1) // 2]
    return xx + np.triu(xx, 1).T, got[n * (n + 1) // 2 : -1]


def _moments(rows: DataFrame, features: tuple[str, ...], y: str, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """X'WX and X'Wy of the features and a constant, in one aggregation."""
    return _matrices(rows.agg(*_products(features, y, weight)).first(), len(features) + 1)


def _standardised(xx: np.ndarray, xy: np.ndarray):
    """Row count, feature means, target mean, scales, and correlations of features and with the target's deviations."""
    n = xx[-1, -1]
    mean, my = xx[-1, :-1] / n, xy[-1] / n
    cov, cxy = xx[:-1, :-1] / n - np.outer(mean, mean), xy[:-1] / n - mean * my
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-24))
    return n, mean, my, scale, cov / np.outer(scale, scale), cxy / scale


def solve_ridge(xx: np.ndarray, xy: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights and intercept of a ridge regression from its sums."""
    if not xx[-1, -1]:
        return np.zeros(len(xx))
    n, mean, my, scale, corr, cxy = _standardised(xx, xy)
    w = np.linalg.solve(corr + penalty / n * np.eye(len(corr)), cxy) / scale
    return np.append(w, my - mean @ w)


def solve_elastic_net(xx: np.ndarray, xy: np.ndarray, penalty: float = 0.1, l1_part: float = 0.5, rounds: int = 1000, tolerance: float = 1e-10) -> np.ndarray:
    """Weights and intercept of an elastic net from its sums, by coordinate descent on standardised features: half the mean squared error, plus ``penalty`` times a mix of the absolute and the halved squared weights."""
    if not xx[-1, -1]:
        return np.zeros(len(xx))
    _, mean, my, scale, corr, cxy = _standardised(xx, xy)
    w = np.zeros(len(corr))
    l1, l2 = penalty * l1_part, penalty * (1 - l1_part)
    for _ in range(rounds):
        before = w.copy()
        for j in range(len(w)):
            pull = cxy[j] - corr[j] @ w + corr[j, j] * w[j]
            w[j] = np.sign(pull) * max(abs(pull) - l1, 0.0) / (corr[j, j] + l2)
        if np.abs(w - before).max(initial=0.0) < tolerance:
            break
    w = w / scale
    return np.append(w, my - mean @ w)


def _linear(features: list[str], solution: np.ndarray) -> Linear:
    return Linear(tuple(features), tuple(solution[:-1].tolist()), float(solution[-1]))


def ridge(rows: DataFrame, features: list[str], y: str, penalty: float = 1.0) -> Linear:
    """Ridge regression on standardised features; the intercept is not penalised."""
    return _linear(features, solve_ridge(*_moments(rows, tuple(features), y), penalty))


def elastic_net(rows: DataFrame, features: list[str], y: str, penalty: float = 0.1, l1_part: float = 0.5) -> Linear:
    """Elastic net on standardised features, from one aggregation of the rows."""
    return _linear(features, solve_elastic_net(*_moments(rows, tuple(features), y), penalty, l1_part))


def principal_axes(rows: DataFrame, features: list[str], k: int) -> list[Linear]:
    """The first ``k`` principal axes of the standardised features, as expressions of a row's score on each; an axis's largest weight is positive."""
    xx, _ = _moments(rows.withColumn("__y", F.lit(0.0)), tuple(features), "__y")
    _, mean, _, scale, corr, _ = _standardised(xx, np.zeros(len(xx)))
    axes = np.linalg.eigh(corr)[1][:, ::-1][:, :k]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return [_linear(features, np.append(v / scale, -(mean / scale) @ v)) for v in axes.T]


def logistic(rows: DataFrame, features: list[str], y: str, penalty: float = 1.0, steps: int = 8) -> Linear:
    """Logistic regression by Newton's method, a pass over the rows for each step; the intercept is not penalised."""
    f = tuple(features)
    beta = np.zeros(len(f) + 1)
    off = penalty * np.eye(len(beta))
    off[-1, -1] = 0
    for _ in range(steps):
        m = Linear(f, tuple(beta[:-1].tolist()), float(beta[-1]))
        p = m.probability()
        scored = rows.withColumns({"__p": p}).withColumn("__r", F.col(y) - F.col("__p"))
        hess, _ = _moments(scored, f, y, F.col("__p") * (1 - F.col("__p")))
        _, grad = _moments(scored, f, "__r")
        step = np.linalg.solve(hess + off + 1e-9 * np.eye(len(beta)), grad - off @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return Linear(f, tuple(beta[:-1].tolist()), float(beta[-1]))


#: Groups that a fit of the caller's own is repeated for at most: each is a plan of its own.
MOST_GROUPS = 100


def leave_one_group_out(rows: DataFrame, group: str, features: list[str], y: str, fit=None, solve=solve_ridge) -> DataFrame:
    """``rows`` with pred, each from a model fitted on all other groups.

    A group's sums are one row; those of all others are the total less its own, so
    one aggregation of the rows serves every fold, each fold is solved where its sums
    lie, and nothing grows with the number of groups but rows. A group without others
    has no prediction; rows without a target are predicted and not learned from.
    Models that sums don't decide come as ``fit(rows, features, y)``, which is repeated
    for each group, of which there may be MOST_GROUPS.
    """
    if fit is not None:
        names = rows.select(group).distinct().orderBy(group).limit(MOST_GROUPS + 1).collect()
        if len(names) > MOST_GROUPS:
            raise ValueError(f"more than {MOST_GROUPS} groups of {group}")
        parts = []
        for (name,) in names:
            held = F.col(group).eqNullSafe(F.lit(name))
            parts.append(rows.where(held).withColumn("pred", fit(rows.where(~held), features, y).column()))
        return reduce(lambda a, b: a.unionByName(b), parts) if parts else rows.withColumn("pred", F.lit(None).cast("double"))
    f = tuple(features)
    n = len(f) + 1
    sums = rows.where(F.col(y).isNotNull()).groupBy(F.col(group).alias("__group")).agg(F.array(*[F.coalesce(c, F.lit(0.0)) for c in _products(f, y)]).alias("sums"))
    total = sums.agg(F.array(*[F.sum(F.get("sums", F.lit(k))) for k in range(n * (n + 1) // 2 + n + 1)]).alias("total"))
    folds = rows.select(F.col(group).alias("__group")).distinct()
    mine = sums.withColumnRenamed("__group", "__own")
    folds = folds.join(mine, folds["__group"].eqNullSafe(mine["__own"]), "left").crossJoin(F.broadcast(total)).select("__group", "sums", "total")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for own, every in zip(pdf["sums"], pdf["total"], strict=True):
                every = np.zeros(n * (n + 1) // 2 + n + 1) if every is None else np.asarray(every, dtype=float)
                xx, xy = _matrices(every - (0.0 if own is None else np.asarray(own, dtype=float)), n)
                out.append(solve(xx, xy).tolist() if xx[-1, -1] > 0.5 else None)
            yield pd.DataFrame({"__group": pdf["__group"], "__w": out})

    kind = rows.schema[group].dataType.simpleString()
    weights = folds.mapInPandas(run, f"__group {kind}, __w array<double>")
    pred = sum((F.col(c) * F.get("__w", F.lit(i)) for i, c in enumerate(f)), F.get("__w", F.lit(len(f))))
    return rows.join(weights, rows[group].eqNullSafe(weights["__group"]), "left").withColumn("pred", pred).select(*rows.columns, "pred")


def synthetic_tracks(spark, movies: int = 5, tracks: int = 6, frames: int = 14, seed: int = 0, drift: float = 0.0) -> DataFrame:
    """Random walks with a planted drift, the same for the same seed wherever they are made: movie, track_id, frame, x_px, y_px."""
    rows = spark.range(movies * tracks * frames).select((F.col("id") / (tracks * frames)).cast("bigint").alias("movie"), ((F.col("id") / frames).cast("bigint") % tracks).alias("track_id"), (F.col("id") % frames).cast("int").alias("frame"))
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "movie", "track_id", "frame"), F.lit(1 << 30)) / float(1 << 30)
    length, turn = F.sqrt(-2 * F.log(F.greatest(u(1), F.lit(1e-12)))), 2 * F.pi() * u(2)
    from pyspark.sql import Window

    w = Window.partitionBy("movie", "track_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"sx": length * F.cos(turn) + drift, "sy": length * F.sin(turn)}).select("movie", "track_id", "frame", F.sum("sx").over(w).alias("x_px"), F.sum("sy").over(w).alias("y_px"))
