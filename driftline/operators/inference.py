"""Test statistics and intervals: Holm, conformal, permutation, regression and classification scores, bootstrap by track."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .audit import chance


#: Groups that leave-one-group-out repeats all rows for at most; also what bounds its broadcast.
MOST_GROUPS = 1000


def holm(tests: DataFrame, p: str = "p", name: str = "name") -> DataFrame:
    """``tests`` with p_adjusted: the running maximum of min(1, (m - i) p) in the order of p. The family is one analysis: few rows."""
    order = Window.orderBy(p, name)
    ranked = tests.withColumns({"i": F.row_number().over(order) - 1, "m": F.count("*").over(Window.partitionBy())})
    return ranked.withColumn("p_adjusted", F.max(F.least(F.lit(1.0), (F.col("m") - F.col("i")) * F.col(p))).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("i", "m")


def conformal_quantile(residuals: DataFrame, by: str, alpha: float, residual: str = "residual") -> DataFrame:
    """Per group the ceil((n + 1)(1 - alpha))-th smallest absolute residual; infinite if there are too few."""
    w = Window.partitionBy(by).orderBy(F.abs(residual))
    ranked = residuals.withColumns({"k": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy(by))})
    want = F.ceil((F.col("n") + 1) * F.lit(1.0 - alpha))
    return ranked.groupBy(by).agg(F.coalesce(F.max(F.when(F.col("k") == want, F.abs(residual))), F.lit(float("inf"))).alias("quantile"), F.first("n").alias("n"))


def permutation_p(null: DataFrame, observed: DataFrame, by: str, value: str = "score") -> DataFrame:
    """(1 + null scores at or above the observed one) / (n + 1) per group; equal up to rounding counts as equal."""
    seen = observed.select(by, F.col(value).alias("observed"))
    tie = 1e-9 * F.greatest(F.lit(1.0), F.abs("observed"))
    return null.join(seen, by).groupBy(by).agg(((1 + F.count_if(F.col(value) >= F.col("observed") - tie)) / (F.count("*") + 1)).alias("p"), F.count("*").alias("n_null"))


def regression_scores(rows: DataFrame, *by: str) -> DataFrame:
    """mae, rmse, r2, coverage and mean width of ``rows`` (y, pred, low, high) per group."""
    e = F.col("y") - F.col("pred")
    return rows.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / F.nullif(F.var_pop("y") * F.count("*"), F.lit(0.0))).alias("r2"),
        F.avg((F.col("y").between(F.col("low"), F.col("high"))).cast("double")).alias("coverage"), F.avg(F.col("high") - F.col("low")).alias("width"),
    )


def classification_scores(rows: DataFrame, *by: str) -> DataFrame:
    """Sensitivity, specificity, their mean and accuracy of ``rows`` (truth, predicted: booleans)."""
    t, p = F.col("truth"), F.col("predicted")
    sums = rows.groupBy(*by).agg(F.avg(F.when(t, p.cast("double"))).alias("sensitivity"), F.avg(F.when(~t, (~p).cast("double"))).alias("specificity"), F.avg((t == p).cast("double")).alias("accuracy"))
    return sums.withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2)


def poisson_steps() -> list[float]:
    """Where the distribution of a Poisson(1) number steps up, from 0 on; beyond 13 a draw of 32 bits has a chance below one of its steps."""
    total, term, out = 0.0, math.exp(-1), []
    for k in range(1, 14):
        total += term
        out.append(total)
        term /= k
    return out


def track_bootstrap(rows: DataFrame, n_boot: int = 200, seed: int = 0, level: float = 0.95, unit: str = "track_id", value: str = "value") -> DataFrame:
    """Interval of the mean when whole units are resampled: estimate, ci_low, ci_high, n_units.

    Units shrink to (sum, n) first. Each replicate draws a Poisson(1) number of every
    unit from a hash of (seed, replicate, unit): resampling without moving any rows.
    """
    per = rows.groupBy(unit).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    draws = per.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    u = chance(F.lit(seed), F.col("replicate"), F.col(unit))
    steps = F.lit(0)
    for total in poisson_steps():
        steps = steps + (F.col("u") >= total).cast("int")
    means = draws.withColumn("u", u).withColumn("times", steps).groupBy("replicate").agg((F.sum(F.col("s") * F.col("times")) / F.nullif(F.sum(F.col("n") * F.col("times")), F.lit(0))).alias("mean"))
    ends = means.agg(F.percentile("mean", F.lit((1 - level) / 2)).alias("ci_low"), F.percentile("mean", F.lit((1 + level) / 2)).alias("ci_high"))
    return per.agg((F.sum("s") / F.sum("n")).alias("estimate"), F.count("*").alias("n_units")).crossJoin(F.broadcast(ends))


def group_folds(sizes: DataFrame, k: int, group: str = "group", n: str = "n") -> DataFrame:
    """Folds of whole groups, balanced by size: groups in falling size go to the fold with the least so far, ties to the lower fold.

    A split's groups are settings of one analysis (experiments), so the greedy choice
    is made on the driver over one row per group.
    """
    load, rows = [0] * k, []
    for r in sizes.groupBy(group).agg(F.sum(n).alias("n")).orderBy(F.desc("n"), group).collect():
        fold = load.index(min(load))
        load[fold] += r["n"]
        rows.append((r[group], fold))
    return sizes.sparkSession.createDataFrame(rows, f"{group} {sizes.schema[group].dataType.simpleString()}, fold int")


def leave_one_group_out(rows: DataFrame, group: str) -> DataFrame:
    """Every row once per group as (test_group, is_test): the folds of leave-one-group-out, as rows."""
    groups = rows.select(F.col(group).alias("test_group")).distinct().cache()
    if groups.limit(MOST_GROUPS + 1).count() > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups of {group}: every row is repeated for each")
    return rows.crossJoin(F.broadcast(groups)).withColumn("is_test", F.col(group) == F.col("test_group"))
