"""Scoring in drains that are committed one by one, so a run that stops goes on where it was.

A drain is a share of the proteins.  Its scores are brought down to states that
merge (``alignment.cluster_states``: eight sums for each feature, type and cluster)
and written under the drain's number, over whatever a failed attempt left there;
the keys that it scored follow, and a row in the table of commits comes last.  Only
committed drains are read, so half a drain never counts.  A run skips the drains
that are committed; keys that came to the table later get a drain of their own.

Several runs may share a folder as shards of one job; a shard that is complete says
so, and states are merged only when all have.

Drains are told by a hash of the key unless a column is named; where the tables are
partitioned by that column, a drain reads its own partitions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators.alignment import merged_states, scores_of
from helixframe.sources.files import exists

PARTS = ["shard", "drain"]


def _write(df: DataFrame, path: str) -> None:
    """Replaces the partitions of which ``df`` has rows, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(path)


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """shard, drain, n: the committed drains and how many keys each has."""
    path = f"{folder}/commits"
    return spark.read.parquet(path).select("n", *PARTS) if exists(spark, path) else spark.createDataFrame([], "n long, shard int, drain int")


def _committed(spark: SparkSession, folder: str, what: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{what}").join(F.broadcast(commits(spark, folder).select(*PARTS)), PARTS, "left_semi")  # a row for each drain


def _drained(part: DataFrame, score: Callable[[DataFrame], DataFrame], folder: str, shard: int, drain: int, key: str) -> None:
    spark, named = part.sparkSession, {"shard": F.lit(shard), "drain": F.lit(drain)}
    _write(score(part).withColumns(named), f"{folder}/states")
    keys = part.select(F.col(key).alias("key")).distinct().withColumns(named)
    _write(keys, f"{folder}/keys")
    done = spark.read.parquet(f"{folder}/keys").filter((F.col("shard") == shard) & (F.col("drain") == drain)).count() if exists(spark, f"{folder}/keys") else 0
    _write(spark.createDataFrame([(done, shard, drain)], "n long, shard int, drain int"), f"{folder}/commits")


def run(
    proteins: DataFrame, score: Callable[[DataFrame], DataFrame], folder: str, n_drains: int = 10, shard: int = 0, n_shards: int = 1, most: int | None = None, key: str = "accession", drain: Column | None = None,
) -> int:
    """Scores the proteins of this shard that no committed drain has; returns how many drains it committed.

    ``score`` makes states of some of the proteins.  ``most`` ends the run after that
    many drains; the shard is complete once a run comes to its end.
    """
    spark = proteins.sparkSession
    hashed = F.xxhash64(F.col(key).cast("string"))
    own = proteins.filter(F.pmod(hashed, F.lit(n_shards)) == shard)
    which = F.pmod(F.expr(f"shiftright(xxhash64(cast(`{key}` as string)), 20)"), F.lit(n_drains)) if drain is None else drain
    had = {r["drain"] for r in commits(spark, folder).filter(F.col("shard") == shard).collect()}  # a row for each drain
    ran = 0
    for d in range(n_drains):
        if d not in had and (most is None or ran < most):
            _drained(own.filter(which == d), score, folder, shard, d, key)
            ran += 1
    if most is not None and ran >= most:
        return ran
    late = own.join(_committed(spark, folder, "keys").select("key"), F.col(key) == F.col("key"), "left_anti").filter(F.col(key).isNotNull())
    if late.limit(1).count():
        _drained(late, score, folder, shard, max(n_drains, *(had | {0})) + 1 if had else n_drains, key)
        ran += 1
    spark.createDataFrame([(shard, n_shards)], "shard int, n_shards int").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(f"{folder}/complete")
    return ran


def merged(spark: SparkSession, folder: str) -> DataFrame:
    """Scores from the states of all committed drains; fails unless every shard is complete."""
    known = spark.read.parquet(f"{folder}/complete").collect() if exists(spark, f"{folder}/complete") else []  # a row for each shard
    n_shards = max((r["n_shards"] for r in known), default=1)
    if missing := sorted(set(range(n_shards)) - {r["shard"] for r in known}):
        raise ValueError(f"shards not complete: {missing}")
    return scores_of(merged_states(_committed(spark, folder, "states").drop(*PARTS)))
