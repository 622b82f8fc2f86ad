"""Interval annotations as positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.columns import interval_length, relative_midpoint


#: Annotations of a task, so that what it sorts and groups stays the same however long the table is.
TASK_ROWS = 100_000


def tasks_for(rows: DataFrame, each: int = TASK_ROWS) -> int:
    return max(1, -(-rows.count() // each))


def masks(annotations: DataFrame, lengths: DataFrame) -> DataFrame:
    """accession, annot_type, pos: the positions that a type covers, each once.

    Closed intervals counted from 1 are cut to the sequence and exploded, so what
    follows are equi-joins on the position and no join on a range.
    """
    return merged_types(annotations, lengths).select("accession", "annot_type", F.explode(F.sequence("a", "b")).alias("pos"))


def merged_types(annotations: DataFrame, lengths: DataFrame, carried: tuple[str, ...] = (), gap: int = 0) -> DataFrame:
    """``merged`` by accession and annot_type, the annotations' feature_type."""
    return merged(annotations.withColumn("annot_type", F.col("feature_type")), lengths, ["accession", "annot_type", *carried], gap)


def merged(annotations: DataFrame, lengths: DataFrame, keys: list[str], gap: int = 0, tasks: int | None = None) -> DataFrame:
    """keys, a, b: the intervals of each key, cut to the sequence, those that overlap as one; with a ``gap`` of 1 those that adjoin, too.

    ``keys`` has accession, and may have length.  Both tables are dealt out by
    accession once, into as many tasks as the annotations' number asks for; what
    is grouped by accession and more afterwards stays there.
    """
    tasks = tasks or tasks_for(annotations)
    own = annotations.select("accession", *[k for k in keys if k not in ("accession", "length")], "start", "end").repartition(tasks, "accession")
    joined = own.join(_dealt(lengths, tasks).hint("merge"), "accession")
    inside = joined.select(*keys, F.greatest(F.col("start"), F.lit(1)).alias("a"), F.least("end", "length").alias("b")).filter("a <= b")
    order = Window.partitionBy(*keys).orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = inside.withColumn("begins", F.when(F.col("a") <= before + gap, 0).otherwise(1)).withColumn("island", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return begun.groupBy(*keys, "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("island")


def _dealt(lengths: DataFrame, tasks: int) -> DataFrame:
    return lengths.select("accession", "length").repartition(tasks, "accession")


def extents(annotations: DataFrame, lengths: DataFrame) -> DataFrame:
    """accession, annot_type, n, first, last: how many positions a type covers, the first and the last; from intervals, not position by position."""
    apart = merged_types(annotations, lengths)
    return apart.groupBy("accession", "annot_type").agg(F.sum(F.col("b") - F.col("a") + 1).alias("n"), F.min("a").alias("first"), F.max("b").alias("last"))


def mask_runs(annotations: DataFrame, lengths: DataFrame) -> DataFrame:
    """accession, annot_type, first, last, run_length: the ``runs`` of ``masks``, from intervals, not position by position."""
    apart = merged_types(annotations, lengths, gap=1)
    return apart.select("accession", "annot_type", F.col("a").alias("first"), F.col("b").alias("last"), (F.col("b") - F.col("a") + 1).cast("long").alias("run_length"))


#: Positions of a bin that intervals are cut at.
BIN = 64


def _bin(pos: Column) -> Column:
    return F.floor((pos - 1) / BIN)


def covering(positions: DataFrame, intervals: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``positions`` (keys, pos) with the intervals (keys, a, b) that cover them, by an equi-join on keys and bins.

    An interval is a row for each ``BIN`` positions that it touches, so what is
    shuffled grows with positions and intervals, not with what these cover.
    """
    cut = intervals.withColumn("_bin", F.explode(F.sequence(_bin(F.col("a")), _bin(F.col("b")))))
    rows, cut = positions.withColumn("_bin", _bin(F.col("pos"))).alias("_p"), cut.alias("_c")
    on = [F.col(f"_p.{k}") == F.col(f"_c.{k}") for k in [*keys, "_bin"]] + [F.col("pos").between(F.col("a"), F.col("b"))]
    rest = [F.col(f"_c.{c}") for c in intervals.columns if c not in keys]
    return rows.join(cut, on, how).select(*[F.col(f"_p.{c}") for c in positions.columns], *rest)


def as_intervals(positions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b: the runs of positions."""
    return runs(positions.select(*keys, "pos").distinct(), keys).select(*keys, F.col("first").alias("a"), F.col("last").alias("b"))


def coverage(annotations: DataFrame, lengths: DataFrame) -> DataFrame:
    """Positions of each accession under any annotation, and their share of the length."""
    tasks = tasks_for(annotations)
    covered = merged(annotations, lengths, ["accession"], tasks=tasks).groupBy("accession").agg(F.sum(F.col("b") - F.col("a") + 1).alias("covered"))
    return _dealt(lengths, tasks).join(covered.hint("merge"), "accession", "left").select("accession", "length", F.coalesce("covered", F.lit(0)).alias("covered")).withColumn("share", F.col("covered") / F.nullif(F.col("length").cast("double"), F.lit(0.0)))


def with_geometry(annotations: DataFrame, lengths: DataFrame) -> DataFrame:
    joined = annotations.join(lengths, "accession")
    return joined.withColumns({"span": interval_length(F.col("start"), F.col("end")), "relative": relative_midpoint(F.col("start"), F.col("end"), F.col("length"))})


def runs(positions: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of consecutive positions of each key: first, last, run_length."""
    island = F.col("pos") - F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    grouped = positions.withColumn("_island", island).groupBy(*keys, "_island")
    return grouped.agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("run_length")).drop("_island")


def type_pairs(annotations: DataFrame) -> DataFrame:
    """Accessions in which two types occur together: type_a, type_b, n; no type with itself."""
    own = annotations.select("accession", "feature_type").distinct()
    other = own.select("accession", F.col("feature_type").alias("type_b"))
    pairs = own.withColumnRenamed("feature_type", "type_a").join(other, "accession").filter("type_a != type_b")
    return pairs.groupBy("type_a", "type_b").agg(F.count("*").alias("n"))


def binned_share(intervals: DataFrame, lengths: DataFrame | None, keys: list[str], bins: int = 100) -> DataFrame:
    """keys, bin, share: how much of each bin's slice of positions the intervals (keys, a, b; apart from each other) cover; bins that they miss are left out.

    An interval is dealt to the bins that it touches and never laid out by position.
    Intervals that carry the length of their accession need no ``lengths``.
    """
    joined = intervals if lengths is None else intervals.join(lengths.select("accession", "length"), "accession")
    size = F.col("length")
    first, last = F.greatest(F.floor((F.col("a") - 1) * bins / size) - 1, F.lit(0)), F.least(F.ceil(F.col("b") * bins / size), F.lit(bins - 1))
    dealt = joined.withColumn("bin", F.explode(F.sequence(first, last)))
    low = F.expr(f"(bin * length) div {bins}")
    high = F.greatest(F.expr(f"((bin + 1) * length) div {bins}"), low + 1)
    met = F.least("b", high) - F.greatest(F.col("a") - 1, low)
    return dealt.withColumn("_met", met / (high - low)).filter("_met > 0").groupBy(*keys, F.col("bin").cast("int").alias("bin")).agg(F.sum("_met").alias("share"))


def contour(cells: DataFrame, keys: list[str], value: str = "share", threshold: float = 0.3) -> DataFrame:
    """keys, first, last, x, width: runs of bins whose value is over the threshold, and their outline in a heat strip, half a bin to the left."""
    over = cells.filter(F.round(value, 9) > threshold).select(*keys, F.col("bin").alias("pos"))
    return runs(over, keys).select(*keys, "first", "last", (F.col("first") - 0.5).alias("x"), F.col("run_length").alias("width"))
