"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.plans.staging import staged


def quantiles(df: DataFrame, keys: list[str], value: str | Column, probs: list[float], weight: str | None = None) -> DataFrame:
    """keys, q: the interpolated quantiles of ``value`` in each group, in the order of ``probs``; null values don't count.

    Equal values are counted first.  They are dealt out by ranges of (keys, value),
    the counts of each range tell which holds a wanted rank, and only these ranges
    are sorted: no task holds more than a range, however large a group is.
    ``weight`` is how often a row counts.
    """
    times = F.lit(1) if weight is None else F.col(weight)
    own = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.col(value) if isinstance(value, str) else value).cast("double").alias("_v"), times.cast("long").alias("_c"))
    names = [f"_k{i}" for i in range(len(keys))]
    counted = own.filter(F.col("_v").isNotNull() & (F.col("_c") > 0)).groupBy(*names, "_v").agg(F.sum("_c").alias("_c"))
    ranged = staged(counted.repartitionByRange(*names, "_v").withColumn("_part", F.spark_partition_id()).select("_part", F.struct(F.lit(0).alias("_"), *names).alias("_key"), "_v", "_c"))
    sizes = ranged.groupBy("_key", "_part").agg(F.sum("_c").alias("_n"))  # a row for each range and each group
    along = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(along), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy("_key"))})
    rank = [F.lit(float(p)) * (F.col("_all") - 1) for p in probs]
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), r.alias("rank")) for i, r in enumerate(rank)]))
    wanted = sizes.select("_key", "_part", "_before", "_n", wanted.alias("w")).select("_key", "_part", "_before", "_n", "w.i", "w.rank")
    low, high = F.floor("rank"), F.ceil("rank")
    held = wanted.filter((high >= F.col("_before")) & (low < F.col("_before") + F.col("_n"))).drop("_n")
    sorted_ = ranged.join(held.select("_key", "_part", "_before").distinct(), ["_key", "_part"])
    upto = F.sum("_c").over(Window.partitionBy("_key", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    places = sorted_.select("_key", "_part", "_v", (F.col("_before") + upto - F.col("_c")).alias("_from"), (F.col("_before") + upto).alias("_to"))
    hit = places.join(held.drop("_before"), ["_key", "_part"]).filter((F.col("_to") > low) & (F.col("_from") <= high))
    ends = hit.groupBy("_key", "i", "rank").agg(
        F.max(F.when((F.col("_from") <= low) & (low < F.col("_to")), F.col("_v"))).alias("a"), F.max(F.when((F.col("_from") <= high) & (high < F.col("_to")), F.col("_v"))).alias("b")
    )
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((high - F.col("rank")) * F.col("a") + (F.col("rank") - low) * F.col("b"))
    listed = ends.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("i", between.alias("v")))).alias("q"))  # a value for each of probs
    return listed.select(*[F.col(f"_key.{n}").alias(k) for n, k in zip(names, keys, strict=True)], F.transform("q", lambda s: s["v"]).alias("q"))
