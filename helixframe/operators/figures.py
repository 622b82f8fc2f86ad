"""The tables behind figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def heat_matrix(scores: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """Mean ``value`` of each (row, column), a column for each of ``columns``, 0 where there is none."""
    return scores.groupBy(row).pivot(column, columns).agg(F.avg(value)).na.fill(0.0)


def last_matrix(rows: DataFrame, row: str, column: str, value: str, order: str, columns: list) -> DataFrame:
    """As ``heat_matrix``, with the value of the last row in ``order`` instead of the mean."""
    return rows.groupBy(row).pivot(column, columns).agg(F.max_by(value, order)).na.fill(0.0)


def column_order(scores: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Each column's place in a heat map: by the row where its mean is largest, then by that mean, larger first."""
    cells = scores.groupBy(row, column).agg(F.avg(value).alias("v"))
    peaks = cells.withColumn("_nth", F.row_number().over(Window.partitionBy(column).orderBy(F.desc("v"), row))).filter("_nth = 1")
    within = Window.partitionBy(F.lit(0)).orderBy(row, F.desc("v"), column)  # a row for each column of a figure
    return peaks.select(column, F.col(row).alias("peak"), F.col("v").alias("peak_value"), F.row_number().over(within).alias("place"))


def unique_in_order(lists: list[DataFrame], key: str, rank: str, n: int = 25) -> DataFrame:
    """The first ``n`` distinct keys of several ranked lists laid end to end."""
    tagged = [df.select(F.col(key).alias("key"), F.struct(F.lit(i).alias("list"), F.col(rank).alias("rank")).alias("at")) for i, df in enumerate(lists)]
    rows = tagged[0]
    for other in tagged[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("key").agg(F.min("at").alias("at")).orderBy("at", "key").limit(n).select("key")


def normalized_evidence(evidence: DataFrame) -> DataFrame:
    """Metrics scaled to 0..1: an effect of 2 is full, a cosine of -1 none; a share and a score are as they are."""
    return evidence.withColumns({"cohen_d": F.least(F.abs("cohen_d"), F.lit(2.0)) / 2, "cosine": (F.col("cosine") + 1) / 2})


def without_empty_metrics(evidence: DataFrame, metrics: list[str]) -> DataFrame:
    """``evidence`` without the metrics that are 0 or missing in every row."""
    used = evidence.agg(*[F.coalesce(F.max(F.abs(m)), F.lit(0.0)).alias(m) for m in metrics]).first()
    return evidence.drop(*[m for m in metrics if not used[m]])


def best_accession(contrasts: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row of the largest contrast, ties by accession."""
    order = Window.partitionBy(*keys).orderBy(F.desc("contrast"), "accession")
    return contrasts.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")


def property_effects(residues: DataFrame, scales: DataFrame) -> DataFrame:
    """Per property the means inside and outside of a mask after scaling the property to 0..1, and the effect over the pooled deviation.

    ``residues`` has residue and inside; one without a value counts as the least.
    """
    counts = residues.groupBy("residue", "inside").agg(F.count("*").alias("n"))  # a few dozen rows
    values = counts.join(F.broadcast(scales), "residue")
    span = F.broadcast(values.groupBy("property").agg(F.min("value").alias("low"), F.max("value").alias("high")))
    scaled = values.join(span, "property").withColumn("v", (F.col("value") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)))

    def moments(side: int, mean: str, variance: str) -> list:
        times = F.when(F.col("inside") == side, F.col("n"))
        known, square = F.sum(times * F.col("v")) / F.sum(times), F.sum(times * F.col("v") * F.col("v")) / F.sum(times)
        return [known.alias(mean), F.greatest(square - known * known, F.lit(0.0)).alias(variance)]

    grouped = scaled.groupBy("property").agg(*moments(1, "mean_in", "vi"), *moments(0, "mean_out", "vo"))
    pooled = F.sqrt((F.col("vi") + F.col("vo")) / 2)
    return grouped.select("property", "mean_in", "mean_out", ((F.col("mean_in") - F.col("mean_out")) / F.nullif(pooled, F.lit(0.0))).alias("effect"))


def strongest_property(effects: DataFrame) -> DataFrame:
    return effects.agg(F.max_by("property", F.abs("effect")).alias("property"), F.max(F.abs("effect")).alias("effect"))
