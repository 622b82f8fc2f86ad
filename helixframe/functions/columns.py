"""Column expressions over interval-annotated sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(c: str | Column) -> Column:
    """A join key: cast to text and trimmed."""
    return F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))


def category(c: str | Column) -> Column:
    """A category: lower-cased and trimmed."""
    return F.lower(F.trim(c))


def interval_length(start: Column, end: Column) -> Column:
    """Positions in a closed interval, whichever end comes first."""
    return F.abs(end - start) + 1


def relative_midpoint(start: Column, end: Column, length: Column) -> Column:
    """The interval's middle as a share of the length; null for an empty sequence."""
    return ((start + end) / 2) / F.nullif(length.cast("double"), F.lit(0.0))


def density(n: Column, length: Column, per: int = 100) -> Column:
    """Occurrences per ``per`` positions; a length below one counts as one."""
    return n / F.greatest(length.cast("double"), F.lit(1.0)) * per


def clipped(c: Column, low=None, high=None) -> Column:
    if low is not None:
        c = F.greatest(c, F.lit(low))
    return c if high is None else F.least(c, F.lit(high))


def truncated(c: Column, n: int) -> Column:
    """At most ``n`` characters, and an ellipsis if some are left out."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("…"))).otherwise(c)


def labelled(c: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The label of the first rule (part of the lower-cased text, label) that fits."""
    out = F.lit(other)
    for part, label in reversed(rules):
        out = F.when(F.contains(F.lower(c), F.lit(part)), label).otherwise(out)
    return out


def finite_or(c: Column, cap: float) -> Column:
    """``c``, at most ``cap``; infinite and missing values become ``cap``."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), cap).otherwise(F.least(c, F.lit(cap)))


def precision(tp: Column, fp: Column) -> Column:
    return tp / (tp + fp + 1e-9)


def per_protein(n: Column, proteins: Column) -> Column:
    return n / (proteins + 1e-9)


def mystery(best: Column) -> Column:
    """How much of a feature its best score leaves unexplained."""
    return 1 - best


def harmonic(a: Column, b: Column) -> Column:
    """The harmonic mean, 0 where both are 0."""
    return F.when(a + b > 0, F.lit(2) * a * b / F.nullif(a + b, F.lit(0.0))).otherwise(0.0)


def min_max(c: Column, window) -> Column:
    """``c`` scaled to 0..1 inside the window."""
    return (c - F.min(c).over(window)) / (F.max(c).over(window) - F.min(c).over(window) + 1e-8)


def histogram_bin(c: Column, low: float, high: float, bins: int) -> Column:
    """The bin of ``c``, counted from 0; the last bin is closed, and values outside have none."""
    at = F.floor((c - low) / ((high - low) / bins)).cast("int")
    return F.when((c >= low) & (c <= high), F.least(at, F.lit(bins - 1)))


def none_if_nan(c: Column) -> Column:
    """NaN as null, so that it neither sorts first nor spoils an aggregate."""
    return F.when(~F.isnan(c), c)


def alphabet_only(c: Column, alphabet: str) -> Column:
    """Whether a non-empty text has letters of ``alphabet`` only."""
    return c.rlike(f"^[{alphabet}]+$")
