"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.plans.staging import staged


def _to_least(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with m, the least of u and all of its v.

    The least is a partial aggregate and the join can be split, so a node with
    very many neighbours does not fall to one task.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _to_least(both).filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` go from the larger to the smaller end."""
    near = _to_least(edges)
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(near.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge to another; component is the least node reachable.

    Null ends and loops are ignored.
    """
    stars = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    seen = _digest(stars)
    while seen[0]:
        stars = staged(_small_star(_large_star(stars)))
        now = _digest(stars)
        if now == seen:
            break
        seen = now
    centres = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(centres)
