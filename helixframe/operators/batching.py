"""Dealing sequences out to batches, chunks and shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.plans.staging import staged


def numbered(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """``rows`` with nth, from 0, among the rows of equal ``by`` in ``order``.

    Ranges of (by, order) are numbered apart and offset by what lies in the ranges
    before, so no task sees more than a range, however many rows one ``by`` has.
    Rows of a null ``by`` are left out.
    The ranges are staged: they are drawn from a sample, and both uses must agree.
    """
    ranged = staged(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part", *by).agg(F.count("*").alias("_n"))  # at most a row for each range and each ``by``
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", *by, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order)) - 1
    return ranged.withColumn("_within", within).join(offsets, ["_part", *by]).withColumn("nth", F.col("_before") + F.col("_within")).drop("_part", "_before", "_within")


def length_buckets(sequences: DataFrame, width: int = 64, size: int = 16, key: str = "accession", length: str = "length") -> DataFrame:
    """bucket (the length, rounded down to ``width``) and chunk (of ``size`` within the bucket); empty sequences are left out."""
    used = sequences.filter(F.col(length) > 0).withColumn("bucket", F.floor(F.col(length) / width) * width)
    return numbered(used, ["bucket"], [F.col(key)]).withColumn("chunk", F.floor(F.col("nth") / size)).drop("nth")


def shard_slices(rows: DataFrame, n: int, key: str = "accession") -> DataFrame:
    """Contiguous slices in order of the key, as even as they go: shard from 0."""
    total = F.broadcast(rows.agg(F.count("*").alias("_total")))  # one row
    return numbered(rows, [], [F.col(key)]).join(total).withColumn("shard", F.floor(F.col("nth") / F.ceil(F.col("_total") / n))).drop("nth", "_total")


def positioned(rows: DataFrame, order: list, size: str) -> DataFrame:
    """``rows`` with before, the sum of ``size`` over the rows that come earlier in ``order``; summed by ranges that are offset."""
    ranged = staged(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.sum(size).alias("_total"))  # a row for each range
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_within", F.coalesce(F.sum(size).over(within), F.lit(0))).join(offsets, "_part")
    return summed.withColumn("before", (F.col("_offset") + F.col("_within")).cast("long")).drop("_part", "_offset", "_within")


#: Budgets that a slice of the order is long.
SLICE = 1024


def _pointers(before: np.ndarray, after: np.ndarray, own: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the first ``own`` rows where a batch that it begins ends, and the row that begins the next (``own`` for one further on)."""
    last = np.searchsorted(after, before[:own] + budget, side="right") - 1
    end = np.where(last >= np.arange(own), after[last], after[:own])  # a row over the budget is alone
    return end, np.searchsorted(before[:own], end)


def _sorted_slice(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, int]:
    table = table.sort_by([("own", "descending"), ("before", "ascending"), ("after", "ascending")])
    sized = table.filter(pc.greater(table["after"], table["before"]))
    return table, sized["before"].to_numpy(), sized["after"].to_numpy(), pc.sum(sized["own"].cast(pa.int64())).as_py() or 0


def _jumps(table: pa.Table, budget: int, width: int) -> pa.Table:
    """Where the batches of a slice lead: for each row that can begin its first batch, the end of its last one and their number."""
    _, before, after, own = _sorted_slice(table)
    end, following = _pointers(before, after, own, budget)
    inside = following < own
    at, moved = np.where(inside, following, np.arange(own)), inside.astype(np.int64)
    for _ in range(max(own, 1).bit_length()):  # pointers of twice the length each time
        moved, at = moved + moved[at], at[at]
    first = (before[:own] % width <= budget) | (np.arange(own) == 0)
    return pa.table({"entry": before[:own][first], "exit": end[at][first], "n": (moved + 1)[first]})


def _placed(table: pa.Table, budget: int) -> pa.Table:
    """The rows of a slice with their batches, from its first start and the number of batches before."""
    table, before, after, own = _sorted_slice(table)
    mine = table.filter(table["own"])
    starts = []
    if own and (entry := mine["entry"][0].as_py()) is not None:
        _, following = _pointers(before, after, own, budget)
        at = int(np.searchsorted(before[:own], entry))
        while at < own:
            starts.append(before[at])
            at = int(following[at])
    begins, ends = mine["before"].to_numpy(), mine["after"].to_numpy()
    # A row of no size goes to the batch that is under way.
    nth = np.where(ends > begins, np.searchsorted(starts, begins, side="right"), np.searchsorted(starts, begins, side="left"))
    batch = np.maximum(mine["earlier"].to_numpy() + nth - 1, 0)
    return pa.table({"row": mine["row"], "batch": pa.array(batch, pa.int64())})


def greedy_batches(rows: DataFrame, order: list[tuple[str, bool]], size: Column, budget: int, slice_width: int | None = None) -> DataFrame:
    """``rows`` with batch: in ``order`` ((column, whether downwards), without ties that matter), filled up to ``budget``; a row over it is alone.

    A batch depends on all before it.  The order is cut into slices of
    ``slice_width`` sizes (``SLICE`` budgets unless named); in each, prefix sums tell
    where a batch from any row ends, and pointers of doubling length where the
    batches lead that the slice may begin with.  Slices are so put together by
    joins of doubling length, as many as the logarithm of their number, and each is
    filled once its first start is known.  The borders are those of one loop over
    all rows, whatever the slices.  A row of no size or of null goes to the batch
    under way.
    """
    width = max(slice_width or SLICE * budget, budget, 1)
    given = rows.select(F.struct(*rows.columns).alias("row"), *[c.alias(f"_by{i}") for i, c in enumerate(_plain(order))], F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("_size"))
    placed = staged(positioned(given, _renamed(order), "_size").select("row", "before", (F.col("before") + F.col("_size")).alias("after"), F.expr(f"before div {width}").alias("slice")))
    bare = placed.filter("after > before").select("slice", "before", "after")
    # The rows that a slice's last batch may reach.
    ahead = bare.filter(F.col("before") % width < budget).select((F.col("slice") - 1).alias("slice"), "before", "after", F.lit(False).alias("own"))
    sized = bare.withColumn("own", F.lit(True)).unionByName(ahead.filter("slice >= 0"))
    jumps = staged(sized.groupBy("slice").applyInArrow(lambda t: _jumps(t, budget, width), "entry long, exit long, n long"))
    n_slices = placed.agg(F.max("slice")).first()[0] or 0
    reached, leap = jumps.filter("entry = 0").select("entry"), jumps.select("entry", "exit")
    for _ in range(int(n_slices).bit_length()):
        reached = staged(reached.unionAll(reached.join(leap, "entry").select(F.col("exit").alias("entry"))).distinct())
        leap = staged(leap.join(leap.select(F.col("entry").alias("exit"), F.col("exit").alias("further")), "exit").select("entry", F.col("further").alias("exit")))
    begun = jumps.join(reached, "entry").select(F.expr(f"entry div {width}").alias("slice"), "entry", "n")
    slices = placed.select("slice").distinct().join(begun, "slice", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    counted = positioned(slices, [F.col("slice")], "n").select("slice", "entry", F.col("before").alias("earlier"))
    whole = placed.join(counted, "slice").select("slice", "before", "after", F.lit(True).alias("own"), "row", "entry", "earlier")
    beside = ahead.filter("slice >= 0").select("slice", "before", "after", "own", F.lit(None).cast(placed.schema["row"].dataType).alias("row"), F.lit(None).cast("long").alias("entry"), F.lit(None).cast("long").alias("earlier"))
    schema = T.StructType([T.StructField("row", placed.schema["row"].dataType), T.StructField("batch", T.LongType())])
    return whole.unionByName(beside).groupBy("slice").applyInArrow(lambda t: _placed(t, budget), schema).select("row.*", "batch")


def _plain(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(c) for c, _ in order]


def _renamed(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(f"_by{i}").desc() if down else F.col(f"_by{i}").asc() for i, (_, down) in enumerate(order)]


def token_batches(sequences: DataFrame, budget: int = 4096, extra: int = 2, key: str = "accession", length: str = "length", slice_width: int | None = None) -> DataFrame:
    """batch: sequences, longest first and ties by key, filled up to ``budget`` tokens, ``extra`` for each.

    A sequence over the budget is alone; a missing length counts as 0.
    """
    known = sequences.withColumn(length, F.coalesce(length, F.lit(0).cast(sequences.schema[length].dataType)))
    return greedy_batches(known, [(length, True), (key, False)], F.col(length) + extra, budget, slice_width)


def boundary_chunks(proteins: DataFrame, size: int = 2048, key: str = "accession", length: str = "length", slice_width: int | None = None) -> DataFrame:
    """chunk: whole proteins in order of the key, as many as ``size`` residues hold; a longer protein is a chunk of its own."""
    return greedy_batches(proteins, [(key, False)], F.col(length), size, slice_width).withColumnRenamed("batch", "chunk")


def residue_chunks(residues: DataFrame, size: int = 2048) -> DataFrame:
    """chunk: residues in order of accession and position, ``size`` to a chunk.

    Chunks that end with a protein are ``boundary_chunks``.
    """
    return numbered(residues, [], [F.col("accession"), F.col("pos")]).withColumn("chunk", F.floor(F.col("nth") / size)).drop("nth")
