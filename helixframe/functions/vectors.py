"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null where a vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def relu(a: Column | str) -> Column:
    return F.transform(a, lambda x: F.greatest(x, F.lit(0.0)))


def standardized(x: Column | str, mean: Column | str, sd: Column | str, least: float = 1e-6) -> Column:
    """(x - mean) / sd for each component, with ``sd`` not below ``least``."""
    both = F.arrays_zip(F.transform(mean, lambda m: m).alias("m"), F.transform(sd, lambda s: s).alias("s"))
    return F.zip_with(x, both, lambda v, p: (v - p["m"]) / F.greatest(p["s"], F.lit(least)))
