"""Descriptive statistics, split quality, and the data behind figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.prep import SPLITS
from helixframe.operators.quantiles import quantiles


def describe(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """count, mean, std (sample), min, quartiles and max."""
    keys = keys or []
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = quantiles(df, keys, value, [0.25, 0.5, 0.75])
    same = [F.col(k).eqNullSafe(F.col(f"_q.{k}")) for k in keys]
    q = q.select(F.struct(*q.columns).alias("_q"))
    out = (out.join(q, reduce(Column.__and__, same), "left") if keys else out.join(F.broadcast(q), how="left")).withColumn("q", F.col("_q.q")).drop("_q")
    return out.withColumns({"q25": F.get("q", F.lit(0)), "q50": F.get("q", F.lit(1)), "q75": F.get("q", F.lit(2))}).drop("q")


def value_counts(df: DataFrame, by: str) -> DataFrame:
    """Counts by value, most first, with shares; null values are left out."""
    counts = df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total")).drop("total").orderBy(F.desc("n"), by)


def split_summary(members: DataFrame) -> DataFrame:
    """Per split: clusters, members, and their shares of all in percent."""
    grouped = members.groupBy("split").agg(F.count_distinct("cluster_id").alias("n_clusters"), F.count("*").alias("n_members"))
    total = grouped.agg(F.sum("n_clusters").alias("all_clusters"), F.sum("n_members").alias("all_members"))
    share = lambda n, all_: F.col(n) / F.col(all_) * 100
    return grouped.join(F.broadcast(total)).select("split", "n_clusters", "n_members", share("n_clusters", "all_clusters").alias("pct_clusters"), share("n_members", "all_members").alias("pct_members"))


def leakage(members: DataFrame, annotations: DataFrame) -> DataFrame:
    """metric, value: clusters and accessions in several splits, duplicates, annotations without a member."""
    several = lambda key: members.groupBy(key).agg(F.count_distinct("split").alias("n")).filter("n > 1").agg(F.count("*").alias("value"))
    repeated = members.groupBy("accession").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("value"))
    twice = annotations.groupBy(*annotations.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("value"))
    orphans = annotations.join(members, "accession", "left_anti").agg(F.count("*").alias("value"))
    rows = {"clusters_in_several_splits": several("cluster_id"), "accessions_in_several_splits": several("accession"), "repeated_accessions": repeated, "repeated_annotations": twice, "orphan_annotations": orphans}
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("metric"), F.col("value").cast("long").alias("value")) for name, df in rows.items()])


def subset_checks(subset: DataFrame, whole: DataFrame) -> DataFrame:
    """check, ok: whole clusters only, no accession twice, none from outside, none null."""
    sizes = lambda df: df.groupBy("cluster_id").agg(F.count("*").alias("n"))
    cut = sizes(subset).join(sizes(whole).withColumnRenamed("n", "m"), "cluster_id").filter("n != m")
    rows = {
        "whole_clusters": cut, "unique_accessions": subset.groupBy("accession").count().filter("count > 1"), "known_accessions": subset.join(whole, "accession", "left_anti"),
        "no_null_keys": subset.filter("accession is null or cluster_id is null"),
    }
    return reduce(DataFrame.unionByName, [df.agg((F.count("*") == 0).alias("ok")).select(F.lit(name).alias("check"), "ok") for name, df in rows.items()])


def by_split(rows: DataFrame, by: str, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """Counts of each ``by`` in columns for the splits, 0 where there are none."""
    return rows.groupBy(by).pivot("split", list(splits)).count().na.fill(0)


def row_shares(pivoted: DataFrame, columns: tuple[str, ...] = SPLITS) -> DataFrame:
    total = reduce(lambda a, b: a + b, [F.col(c) for c in columns]).cast("double")
    return pivoted.withColumns({c: F.col(c) / F.nullif(total, F.lit(0.0)) for c in columns})


def deviation(shares: DataFrame, expected: dict[str, float]) -> DataFrame:
    """How far each row's shares are from the expected ones, and the largest distance."""
    out = shares.withColumns({f"dev_{c}": F.col(c) - v for c, v in expected.items()})
    return out.withColumn("max_deviation", F.greatest(*[F.abs(f"dev_{c}") for c in expected]))


def top_per_group(df: DataFrame, group: str, by: str, n: int) -> DataFrame:
    """The ``n`` most frequent ``by`` of each group."""
    counts = df.groupBy(group, by).agg(F.count("*").alias("n"))
    return counts.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), by))).filter(F.col("nth") <= n)


def mean_per_member(annotations: DataFrame) -> DataFrame:
    """Mean count of each type over the accessions that have it."""
    per = annotations.groupBy("accession", "feature_type").agg(F.count("*").alias("n"))
    return per.groupBy("feature_type").agg(F.avg("n").alias("mean_n"), F.count("*").alias("n_accessions"))


def letter_frequency(sequences: DataFrame, alphabet: str | None = None, sequence: str = "sequence") -> DataFrame:
    """Counts and shares of letters, upper-cased."""
    letters = sequences.select(F.explode(F.split(F.upper(sequence), "")).alias("letter")).filter("letter != ''")
    if alphabet:
        letters = letters.filter(F.col("letter").isin(*alphabet))
    counts = letters.groupBy("letter").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("letter", "n", (F.col("n") / F.col("total")).alias("share"))


def log_bins(x: Column, step: float = 0.1) -> Column:
    """The bin of log10, for two-dimensional counts of positive values."""
    return F.floor(F.round(F.log10(F.when(x > 0, x)) / step, 9)).cast("int")


def counts_2d(df: DataFrame, x: Column, y: Column) -> DataFrame:
    return df.select(x.alias("x_bin"), y.alias("y_bin")).dropna().groupBy("x_bin", "y_bin").agg(F.count("*").alias("n"))


def median_trend(df: DataFrame, bin_: Column, value: str, more_than: int = 10) -> DataFrame:
    return df.withColumn("bin", bin_).groupBy("bin").agg(F.median(value).alias("median"), F.count("*").alias("n")).filter(F.col("n") > more_than)


def prefix_owners(scores: DataFrame, n: int) -> DataFrame:
    """One type of each group of types that share the text before a colon, the best, and at most ``n`` of them."""
    order = Window.partitionBy(F.split("annot_type", ":")[0]).orderBy(F.desc("auprc_mean"), "annot_type", "feature_id")
    return scores.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth").orderBy(F.desc("auprc_mean"), "annot_type").limit(n)


def scaled(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """``df`` with score, the value scaled to 0..1 among the rows of equal keys.

    The bounds are partial aggregates joined back, so rows of one key may lie in
    any number of tasks.
    """
    bounds = df.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    return df.join(bounds, keys).withColumn("score", (F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low") + 1e-8)).drop("_low", "_high")


def density_ridge(df: DataFrame, key: str, value: str, bins: int = 80, points: int = 200, least_rows: int = 5, height: float = 0.85) -> DataFrame:
    """key, point, x, y, median: the density of a value in 0..1 at evenly spaced points, by lines between the centres of bins, scaled to ``height`` at its largest.

    Before the first centre and behind the last the line is flat.  Keys of fewer than
    ``least_rows`` values are left out.  A key's bins are one row, as many as named.
    """
    known = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull())
    at = F.least(F.floor(F.round(F.col(value) * bins, 7)), F.lit(bins - 1)).cast("int")  # rounded, so that a value on an edge opens its bin
    counts = known.withColumn("_bin", F.when(F.col(value).between(0, 1), at)).groupBy(key, "_bin").agg(F.count("*").alias("_n"))
    inside = F.col("_bin").isNotNull()
    shapes = counts.groupBy(key).agg(F.sum("_n").alias("_rows"), F.map_from_entries(F.collect_list(F.when(inside, F.struct("_bin", "_n")))).alias("_bins")).filter((F.col("_rows") >= least_rows) & (F.size("_bins") > 0))
    at = shapes.select(key, "_bins", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")).withColumn("x", F.col("point") / (points - 1))
    place = F.greatest(F.least(F.col("x") * bins - 0.5, F.lit(bins - 1.0)), F.lit(0.0))
    low = F.floor(place).cast("int")
    n = lambda b: F.coalesce(F.try_element_at("_bins", F.least(b, F.lit(bins - 1))), F.lit(0))
    lines = at.select(key, "point", "x", (n(low) + (n(low + 1) - n(low)) * (place - low)).alias("_y"))
    peaks = lines.groupBy(key).agg(F.max("_y").alias("_peak"))  # a row for each key
    medians = quantiles(known, [key], value, [0.5]).select(key, F.get("q", F.lit(0)).alias("median"))
    return lines.join(peaks, key).join(medians, key).select(key, "point", "x", (F.col("_y") / F.nullif("_peak", F.lit(0.0)) * height).alias("y"), "median")


def width_average(values: DataFrame, value: str, keys: list[str], share: int = 50, least: int = 3) -> DataFrame:
    """``values`` (keys, pos from 1 without gaps) with length and smooth: the centred average over ``max(least, length // share)`` positions, those beyond the ends as zeros.

    The width follows the length, so a frame of fixed width can't do it: a sum over a
    stretch is the difference of two sums from the start, looked up by position.  A
    key is one sequence and its positions are sorted together.
    """
    along = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = values.withColumns({"_upto": F.sum(value).over(along), "length": F.count("*").over(Window.partitionBy(*keys))})
    width = F.greatest(F.lit(least), F.expr(f"length div {share}"))
    before, behind = F.expr("_w div 2"), F.expr("(_w - 1) div 2")
    rows = summed.withColumn("_w", width.cast("long"))
    rows = rows.withColumns({"_high": F.least(F.col("pos") + behind, F.col("length")), "_low": F.col("pos") - before - 1})
    sums = summed.select(*keys, F.col("pos").alias("_at"), F.col("_upto").alias("_s"))
    for end in ("_high", "_low"):
        own = sums.withColumnRenamed("_at", end).withColumnRenamed("_s", f"_s{end}")
        rows = rows.withColumn(end, F.col(end).cast(own.schema[end].dataType)).join(own, [*keys, end], "left")
    smooth = (F.col("_s_high") - F.coalesce("_s_low", F.lit(0.0))) / F.col("_w")
    return rows.withColumn("smooth", smooth).select(*values.columns, "length", "smooth")


def moving_average(df: DataFrame, value: str, keys: list[str], order: str, width: int) -> Column:
    """The centred average over ``width`` rows, those beyond the ends as zeros."""
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(width // 2), (width - 1) // 2)
    return F.sum(value).over(window) / width
