"""Choosing types, pairs and keys for reports and figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.columns import precision
from helixframe.operators.prep import first_keys
from helixframe.plans.staging import staged


def anchored(c: str | Column, pattern: str) -> Column:
    """Whether a text begins with a match of ``pattern``."""
    return (F.col(c) if isinstance(c, str) else c).rlike(f"^(?:{pattern})")


def above(scores: DataFrame, least: float = 0.3, n: int = 20, score: str = "auprc_mean") -> DataFrame:
    """The ``n`` best pairs among those that score ``least``."""
    return scores.filter(F.col(score) >= least).orderBy(F.desc(score), "feature_id", "annot_type").limit(n)


def by_magnitude(df: DataFrame, effect: str, tie: str, n: int) -> DataFrame:
    """The ``n`` rows of the largest effect in either direction; missing effects come last."""
    return df.orderBy(F.desc_nulls_last(F.abs(effect)), tie).limit(n)


def of_robust_types(rows: DataFrame, summary: DataFrame, least_clusters: int = 3, least_proteins: int = 5) -> DataFrame:
    """Rows of the types that the summary finds in enough clusters, or in enough proteins where it has no clusters."""
    enough = F.col("n_clusters") >= least_clusters if "n_clusters" in summary.columns else F.col("n_proteins") >= least_proteins
    return rows.join(summary.filter(enough).select("annot_type").distinct(), "annot_type", "left_semi")


def described(annotations: DataFrame) -> DataFrame:
    """Annotations whose subtype says more than the type; all of them if none does."""
    finer = F.coalesce(F.col("annot_subtype") != F.col("feature_type"), F.lit(False))
    known = annotations.agg(F.coalesce(F.max(finer), F.lit(False)).alias("_any"))  # one row
    return annotations.join(F.broadcast(known)).filter(finer | ~F.col("_any")).drop("_any")


def counted_with(annotations: DataFrame, sequences: DataFrame, value: str = "length") -> DataFrame:
    """accession, n annotations and the sequence's value, for accessions that have both."""
    counts = annotations.groupBy("accession").agg(F.count("*").alias("n"))
    return counts.join(sequences.select("accession", value), "accession").dropna(subset=["n", value])


def with_group_size(best: DataFrame, rows: DataFrame, by: str, name: str) -> DataFrame:
    """``best`` with the number of ``rows`` of its group; null for a group without any."""
    return best.join(rows.groupBy(by).agg(F.count("*").alias(name)), by, "left")


def carried(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """One row a group with the group's value of each column: the least, where a group has several."""
    return rows.groupBy(by).agg(*[F.min(c).alias(c) for c in columns])


def capped_keys(annotations: DataFrame, n: int, key: str = "accession", group: str = "feature_type") -> DataFrame:
    """The distinct keys among the first ``n`` of every type."""
    return first_keys(annotations, [group], key, n).select(key).distinct()


def precise(scores: DataFrame, least: float = 0.05) -> DataFrame:
    """Pairs whose counts reach a precision."""
    return scores.filter(precision(F.col("tp"), F.col("fp")) >= least)


def figure_types(scores: DataFrame, least: float = 0.5, high: float = 0.95, most: int = 5) -> DataFrame:
    """annot_type, best: types above ``least`` that at most ``most`` features score over ``high``, the best one of each prefix before a colon."""
    several = F.count_distinct(F.when(F.col("auprc_mean") > high, F.col("feature_id")))
    per = scores.groupBy("annot_type").agg(F.max("auprc_mean").alias("best"), several.alias("n_high")).filter((F.col("best") > least) & (F.col("n_high") <= most))
    order = Window.partitionBy(F.trim(F.split("annot_type", ":")[0])).orderBy(F.desc("best"), "annot_type")
    return per.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").select("annot_type", "best")


def owners(types: DataFrame, scores: DataFrame) -> DataFrame:
    """annot_type, feature_id, best: types in order of their best score each take their first feature, or their second if that is taken.

    All types claim at once; of those that claim one feature the first in order keeps
    it and the others claim their second.  As every feature prefers the same types,
    this ends where the turns one by one would.
    """
    order = Window.partitionBy("annot_type").orderBy(F.desc("auprc_mean"), "feature_id")
    ranked = scores.withColumn("nth", F.row_number().over(order)).filter("nth <= 2").select("annot_type", "feature_id", "nth")
    choices = staged(ranked.join(types.select("annot_type", "best"), "annot_type"))
    claims = choices.filter("nth = 1")
    while True:
        turn = F.row_number().over(Window.partitionBy("feature_id").orderBy(F.desc("best"), "annot_type"))
        claims = staged(claims.withColumn("_turn", turn))
        lost = claims.filter("_turn > 1")
        if lost.isEmpty():
            return claims.select("annot_type", "feature_id", "best")
        again = choices.join(lost.select("annot_type", (F.col("nth") + 1).alias("nth")), ["annot_type", "nth"])
        claims = claims.filter("_turn = 1").drop("_turn").unionByName(again)


def histogram(df: DataFrame, value: str, bins: int = 40, log_edges: int = 50, wide: float = 100.0) -> DataFrame:
    """bin, n: equal bins, or bins of equal ratio if the largest value is over ``wide`` times the least plus one.

    Bins of equal ratio lie between the ``log_edges`` edges from the least to the
    largest value, both plus one; values below the first edge have none.
    """
    bounds = df.agg(F.min(value).cast("double").alias("_low"), F.max(value).cast("double").alias("_high"))  # one row
    use_log = F.col("_high") / (F.col("_low") + 1) > wide
    low, high = F.when(use_log, F.log10(F.col("_low") + 1)).otherwise(F.col("_low")), F.when(use_log, F.log10(F.col("_high") + 1)).otherwise(F.col("_high"))
    count = F.when(use_log, F.lit(log_edges - 1)).otherwise(F.lit(bins))
    at = F.when(use_log, F.log10(F.when(F.col(value) > 0, F.col(value)))).otherwise(F.col(value).cast("double"))
    width = F.nullif((high - low) / count, F.lit(0.0))
    nth = F.least(F.floor(F.round(F.coalesce((at - low) / width, F.when(at == low, F.lit(0.0))), 9)), count - 1)
    binned = df.filter(F.col(value).isNotNull()).join(F.broadcast(bounds)).select(nth.cast("int").alias("bin"))
    return binned.filter("bin >= 0").groupBy("bin").agg(F.count("*").alias("n"))
