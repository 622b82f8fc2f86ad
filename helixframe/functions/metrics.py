"""Scores of a latent feature against an annotation."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def odds_ratio(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """tp * tn / (fp * fn); infinite where only that product vanishes, 0 without true positives."""
    return F.when(fp * fn > 0, tp * tn / F.nullif((fp * fn).cast("double"), F.lit(0.0))).when(tp > 0, float("inf")).otherwise(0.0)


def truncated_odds_ratio(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """The odds ratio of the counts cut to whole numbers; null where a margin is empty."""
    a, b, c, d = (F.floor(x).cast("double") for x in (tp, fp, fn, tn))
    empty = (a + b == 0) | (c + d == 0) | (a + c == 0) | (b + d == 0)
    return F.when(empty, None).when(b * c > 0, a * d / F.nullif(b * c, F.lit(0.0))).otherwise(float("inf"))


def _greater(tp: float, fp: float, fn: float, tn: float) -> float:
    a, b, c, d = (math.floor(x) for x in (tp, fp, fn, tn))
    n, row, column = a + b + c + d, a + b, a + c
    if not row or not column or row == n or column == n:
        return 1.0
    choose = lambda x, y: math.lgamma(x + 1) - math.lgamma(y + 1) - math.lgamma(x - y + 1)
    whole = choose(n, column)
    terms = [choose(row, k) + choose(n - row, column - k) - whole for k in range(a, min(row, column) + 1)]
    top = max(terms)
    return min(1.0, math.exp(top) * sum(math.exp(t - top) for t in terms))


def fisher_greater(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """One-sided Fisher exact p of the counts cut to whole numbers; 1 where a margin is empty.

    The hypergeometric tail needs the log-gamma function, which Spark has not.
    """

    def tail(tp: pd.Series, fp: pd.Series, fn: pd.Series, tn: pd.Series) -> pd.Series:
        return pd.Series([_greater(*x) for x in zip(tp, fp, fn, tn, strict=True)], dtype=float)

    return F.pandas_udf(tail, "double")(*(x.cast("double") for x in (tp, fp, fn, tn)))


def expected_overlap(active: Column, positive: Column, tp: Column, length: Column) -> Column:
    """Mean overlap of the activation with the mask over all circular shifts but none; null for one position."""
    return (active * positive - tp) / F.nullif((length - 1).cast("double"), F.lit(0.0))


def cohen_d(mean1: Column, sd1: Column, mean2: Column, sd2: Column) -> Column:
    """Difference of means over the root of the mean variance; 0 where that vanishes."""
    pooled = F.sqrt((sd1 * sd1 + sd2 * sd2) / 2)
    return F.when(pooled > 0, (mean1 - mean2) / F.nullif(pooled, F.lit(0.0))).otherwise(0.0)


def geometric_mean(c: Column) -> Column:
    """Over the positive values of a group."""
    return F.exp(F.avg(F.ln(F.when(c > 0, c))))


def r_squared(x: str, y: str) -> Column:
    return F.pow(F.corr(x, y), 2)
