"""Exact binomial intervals and what they say of a score."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    total = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def beta_quantile(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_share(mid, a, b) < p else (lo, mid)
    return (lo + hi) / 2


def binomial_interval(hits: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Clopper and Pearson's interval of a share; (0, 1) of nothing."""
    tail = (1 - level) / 2
    low = beta_quantile(tail, hits, n - hits + 1) if hits > 0 else 0.0
    return low, beta_quantile(1 - tail, hits + 1, n - hits) if hits < n else 1.0


def interval_columns(hits: Column, n: Column, level: float = 0.95) -> Column:
    """The interval as a struct (low, high); few distinct counts, each solved once per batch."""

    @F.pandas_udf("low double, high double")
    def solve(h: pd.Series, m: pd.Series) -> pd.DataFrame:
        known = {k: binomial_interval(int(k[0]), int(k[1]), level) for k in set(zip(h, m, strict=True))}
        return pd.DataFrame(np.array([known[k] for k in zip(h, m, strict=True)]).reshape(-1, 2), columns=["low", "high"])

    return solve(hits, n)


def missed_f1_ceiling(missed: Column) -> Column:
    """The best F1 when this share of true objects is not labelled: 2 (1 - m) / (2 - m)."""
    return 2 * (1 - missed) / (2 - missed)
