"""Preparing tables: headers, keys, duplicates, splits, validated joins, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.columns import alphabet_only, category, key

# The splits in their order, the residues, and types that are no use as annotations.
SPLITS = ("train", "val", "test")
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"


def normalized_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def key_column(df: DataFrame, names: list[str]) -> str:
    """The first of ``names`` that the table has, else its first column."""
    return next((n for n in names if n in df.columns), df.columns[0])


def required(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def with_default(df: DataFrame, name: str, value) -> DataFrame:
    """``df`` with the column ``name``, of one value where it had none."""
    return df if name in df.columns else df.withColumn(name, F.lit(value))


def normalized(df: DataFrame, keys: tuple[str, ...] = (), categories: tuple[str, ...] = ()) -> DataFrame:
    return df.withColumns({c: key(c) for c in keys} | {c: category(F.col(c)) for c in categories})


def first_of_each(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key: the first in ``order``, a stated order instead of that in the file."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", first).filter("_nth = 1").drop("_nth")


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs more than once, with group_size."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("group_size")).filter("group_size > 1")
    return df.join(sizes, keys)


def duplicate_count(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row: n rows, n_distinct keys (all columns if none are named), n_duplicates."""
    one = df.groupBy(*(keys or df.columns)).agg(F.count("*").alias("n"))
    return one.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))


def _unique(df: DataFrame, on: str, side: str) -> None:
    twice = df.filter(F.col(on).isNotNull()).groupBy(on).count().filter("count > 1").select(on).limit(1).collect()
    if twice:
        raise ValueError(f"{side} table: key {twice[0][0]!r} is not unique")


def join_one_to_one(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Inner join that fails unless the key is unique on both sides."""
    _unique(left, on, "left")
    return join_many_to_one(left, right, on)


def join_many_to_one(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Inner join that fails unless the key is unique on the right."""
    _unique(right, on, "right")
    return left.join(right, on)


def looked_up(df: DataFrame, lookup: DataFrame, on: str, defaults: dict) -> DataFrame:
    """Left join with a lookup table; what is missing gets a default."""
    return df.join(lookup, on, "left").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def sizes(members: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Members of each cluster; rows of a null cluster are left out."""
    return members.filter(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").alias("size"))


def shuffled(c: str | Column, seed: int) -> Column:
    """A key whose order is a shuffle that any engine repeats."""
    return F.md5(F.concat(F.lit(f"{seed}:"), (F.col(c) if isinstance(c, str) else c).cast("string")))


def sum_before(df: DataFrame, value: str, order: str, tie: str) -> DataFrame:
    """``df`` with before, the sum of ``value`` over the rows that come earlier by ``order``, a hexadecimal key.

    Ranges of the key are summed apart and offset by the sum of the ranges before,
    so no task sees all rows.
    """
    ranged = df.withColumn("_range", F.substring(order, 1, 3))
    totals = ranged.groupBy("_range").agg(F.sum(value).alias("_total"))  # at most 4096 rows
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_range").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0))).join(F.broadcast(offsets), "_range")
    return out.withColumn("before", F.col("_offset") + F.col("_within")).drop("_range", "_offset", "_within")


def cluster_split(clusters: DataFrame, train: float = 0.7, val: float = 0.15, seed: int = 42, cluster: str = "cluster_id", size: str = "size") -> DataFrame:
    """``clusters`` with a split: whole clusters in shuffled order go to train until it has its share, then to val, then to test."""
    if not (train > 0 and val > 0 and train + val < 1):
        raise ValueError("shares have to be positive and leave a test split")
    total = clusters.agg(F.sum(size)).first()[0] or 0
    placed = sum_before(clusters.withColumn("_key", shuffled(cluster, seed)), size, "_key", cluster)
    in_train = F.col("before") < total * train
    train_total = placed.filter(in_train).agg(F.sum(size)).first()[0] or 0
    split = F.when(in_train, "train").when(F.col("before") - train_total < total * val, "val").otherwise("test")
    return placed.withColumn("split", split).drop("_key", "before")


def cluster_subset(clusters: DataFrame, target: float, seed: int = 42, cluster: str = "cluster_id", size: str = "size") -> DataFrame:
    """Whole clusters in shuffled order until they hold ``target`` members; the last may overshoot, one always stays."""
    placed = sum_before(clusters.withColumn("_key", shuffled(cluster, seed)), size, "_key", cluster)
    return placed.filter((F.col("before") < target) | (F.col("before") == 0)).drop("_key", "before")


def shuffled_sample(df: DataFrame, n: int, by: str, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same ones in any engine."""
    return df.orderBy(shuffled(by, seed), by).limit(n)


def promoted_subtypes(annotations: DataFrame) -> DataFrame:
    """feature_type replaced by annot_subtype if that column is used and finer."""
    if "annot_subtype" not in annotations.columns:
        return annotations
    types, subtypes = annotations.agg(F.count_distinct("feature_type"), F.count_distinct("annot_subtype")).first()
    return annotations.withColumn("feature_type", F.coalesce("annot_subtype", "feature_type")) if subtypes > types else annotations


def valid_types(annotations: DataFrame, least_residues: int = 500, least_proteins: int = 30) -> DataFrame:
    """Types with enough positions, overlaps and repeats counted, in enough proteins."""
    grouped = annotations.groupBy("feature_type").agg(F.sum(F.col("end") - F.col("start") + 1).alias("n_residues"), F.count_distinct("accession").alias("n_proteins"))
    return grouped.filter((F.col("n_residues") >= least_residues) & (F.col("n_proteins") >= least_proteins))


def with_skip_reasons(sequences: DataFrame, longest: int = 1022, alphabet: str = RESIDUES, sequence: str = "sequence") -> DataFrame:
    """``sequences`` with skip_reason (null for usable ones) and the usable part, cut to ``longest``."""
    upper = F.upper(F.trim(sequence))
    reason = F.when(upper.isNull() | upper.isin("", "NAN", "NONE"), "empty").when(~alphabet_only(upper, alphabet), "alphabet")
    return sequences.withColumn("skip_reason", reason).withColumn("used", F.when(reason.isNull(), F.substring(upper, 1, longest)))


def first_keys(df: DataFrame, group: list[str], by: str, n: int) -> DataFrame:
    """The first ``n`` distinct values of ``by`` in each group, in order of value."""
    rows = df.select(*group, by).distinct()
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*group).orderBy(by))).filter(F.col("_nth") <= n).drop("_nth")
