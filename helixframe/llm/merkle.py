"""A Merkle manifest of a table: a tree over the rows of each group, one over the groups' roots.

Leaves are hashed by Spark's own functions and numbered within their group by
ranges.  Then come supersteps over RDDs of vertices keyed (group, place): children
send their hash to the parent, and a parent that has all of its children hashes
them and sends on; a group ends when one hash is left.  The groups' roots are the
leaves of a second tree of the same kind.  In reverse supersteps each vertex sends
to its children what stands beside them on the way to the root, so every row gets
its proof without a lookup, and folds its hash, or that of a changed copy, with it.

A vertex stands for ``SPAN`` levels of the tree, so it has at most ``WIDE`` children
and supersteps are few; a path has one entry for each level.  No key grows with the
data: a group of a third of all rows is spread over its places.  The vertices of the
first superstep hold their rows' ids, and each further superstep has fewer by
``WIDE``.  Lineage is cut every ``CUT`` supersteps.

Defined results: a null field is hashed as ``-``, an empty one as ``0:``; rows of a
null group are one group, the first; within a group rows stand by the order column,
nulls first, then by their hash and their changed hash, so the order of the table
doesn't matter; equal rows are leaves of their own, next to each other; a text of
any length is hashed whole, as one value of a task; an empty table gives no rows;
columns other than the named fields are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.operators.batching import numbered
from helixframe.plans.staging import broadcast_if_small, checkpoint_dir, staged

#: Children of a node of the tree.
ARITY = 3
#: Levels of a vertex, and how many children it so has at most.
SPAN = 4
WIDE = ARITY**SPAN
#: Supersteps after which the lineage of vertices and of paths is cut.
CUT = 3
#: Hashes that a task of a superstep handles, about.
HASHES = 100_000


def leaf(columns: Iterable[Column]) -> Column:
    """Hex hash of the columns: each is ``-`` if null, else its bytes' number, a colon and the value as text."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[part(c) for c in columns]), 256)


def parent(children: Iterable[bytes]) -> bytes:
    """The hash of hashes, which go in as hex text."""
    return sha256("".join(c.hex() for c in children).encode()).digest()


def _entry(place: int, beside: list[bytes]) -> bytes:
    """A level of a path: the place among the run, the number of others, and their hashes."""
    return bytes([place, len(beside)]) + b"".join(beside)


def _levels(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(path):
        place, n = path[at], path[at + 1]
        at += 2
        yield place, [path[at + 32 * i : at + 32 * (i + 1)] for i in range(n)]
        at += 32 * n


def siblings(path: bytes) -> list[bytes]:
    """The hashes beside a leaf's way, level by level, left to right."""
    return [s for _, beside in _levels(path) for s in beside]


def folded(digest: bytes, path: bytes) -> bytes:
    """The root that ``digest`` leads to along ``path``."""
    for place, beside in _levels(path):
        digest = parent([*beside[:place], digest, *beside[place:]])
    return digest


def _climbed(n: int, hashes: list[bytes]) -> tuple[int, list[list[bytes]]]:
    """(nodes left in the group, the levels from ``hashes`` on) after ``SPAN`` levels, or as many as the group of ``n`` has."""
    levels = [hashes]
    while n > 1 and len(levels) <= SPAN:
        now = levels[-1]
        levels.append([parent(now[i : i + ARITY]) for i in range(0, len(now), ARITY)])
        n = -(-n // ARITY)
    return n, levels


def _beside(levels: list[list[bytes]], at: int) -> bytes:
    """The path of the child ``at`` to its vertex's top."""
    out = []
    for level in levels[:-1]:
        first = at // ARITY * ARITY
        out.append(_entry(at - first, level[first:at] + level[at + 1 : first + ARITY]))
        at //= ARITY
    return b"".join(out)


def _vertex(key_values: tuple) -> tuple:
    """A vertex of what its children sent: (nodes of their level in the group, children in order)."""
    key, values = key_values
    got = sorted(values, key=lambda v: v[1])
    return key, (got[0][0], [tuple(v[2:]) for v in got])


def _top(vertex: tuple) -> tuple[int, bytes]:
    """(nodes left in the group, the vertex's hash)."""
    n, levels = _climbed(vertex[0], [c[0] for c in vertex[1]])
    return n, levels[-1][0]


def _paths(vertex: tuple) -> Iterator[tuple]:
    """(place among the group's nodes, child, given, path) of a vertex's children."""
    (_, place), (n, children, given, path) = vertex
    _, levels = _climbed(n, [c[0] for c in children])
    for at, child in enumerate(children):
        yield place * WIDE + at, child, given, _beside(levels, at) + path


def _sent_down(vertex: tuple) -> Iterator[tuple]:
    group = vertex[0][0]
    return (((group, place), (given, path)) for place, _, given, path in _paths(vertex))


def _paths_down(steps: list[RDD], ends: RDD, tasks: list[int]) -> RDD:
    """((group, place), (n, children, given, path)) of the first superstep's vertices.

    ``steps`` has the vertices ((group, place), (n, children)) of each superstep;
    ``ends`` has (group, (superstep that it ended in, given, path)).
    """
    below = None
    for k in range(len(steps) - 1, -1, -1):
        begun = ends.filter(lambda e, k=k: e[1][0] == k).map(lambda e: ((e[0], 0), e[1][1:]))
        met = steps[k].join(begun if below is None else begun.union(below), tasks[k]).mapValues(lambda v: (*v[0], *v[1]))
        if k and (len(steps) - k) % CUT == 0:
            met.checkpoint()
            met.count()
        below = met.flatMap(_sent_down)
    return met


def _up(leaves: RDD, largest: int, total: int, least: int) -> tuple[list[RDD], list[int], RDD]:
    """The vertices by superstep, their tasks, and (group, (the superstep that it ended in, hash)) of every group.

    ``leaves`` has ((group, place), (n of the group, place in the vertex, hash, ...)).
    """
    steps, tasks, ends, sent = [], [], [], leaves
    while True:
        k = len(steps)
        tasks.append(max(1, min(max(least, -(-total // HASHES)), -(-total // WIDE**k // 1000))))
        found = sent.map(lambda m: ((m[0][0], m[0][1] // WIDE), m[1])).groupByKey(tasks[k]).map(_vertex, preservesPartitioning=True)
        if k % CUT == CUT - 1:
            found.checkpoint()
            found.count()
        steps.append(found)
        tops = found.mapValues(_top)
        ends.append(tops.filter(lambda t: t[1][0] == 1).map(lambda t, k=k: (t[0][0], (k, t[1][1]))))
        if largest <= WIDE ** (k + 1):
            return steps, tasks, leaves.context.union(ends)
        sent = tops.filter(lambda t: t[1][0] > 1).map(lambda t: (t[0], (t[1][0], t[0][1] % WIDE, t[1][1])))


def tree(rows: DataFrame, group: str = "group", order: str = "place", kept: Iterable[str] = ()) -> tuple[RDD, bytes | None]:
    """Every row with its path, and the root (null for no rows).

    ``rows`` has group, place (the order within the group), leaf and changed (hashes
    in binary; changed may be null), and what ``kept`` names.  Returned are tuples
    (*kept, leaf, changed, the group's root, path).
    """
    spark, kept = rows.sparkSession, list(kept)
    checkpoint_dir(spark)
    known = staged(rows.select(F.col(group).alias("_group"), F.col(order).alias("_order"), "leaf", "changed", *[F.col(c).alias(f"_kept{i}") for i, c in enumerate(kept)]))
    sizes = staged(known.groupBy("_group").agg(F.count("*").alias("_n")))
    n_groups, largest, total = sizes.agg(F.count("*"), F.max("_n"), F.sum("_n")).first()
    if not n_groups:
        return spark.sparkContext.emptyRDD(), None
    named = staged(numbered(sizes, [], [F.asc_nulls_first("_group")]).select("_group", "_n", F.col("nth").alias("_id")))
    few = broadcast_if_small(named).withColumnRenamed("_group", "_named")
    given = known.join(few, F.col("_group").eqNullSafe(F.col("_named")))
    placed = numbered(given, ["_id"], [F.asc_nulls_first("_order"), F.col("leaf"), F.asc_nulls_first("changed"), *[F.asc_nulls_first(f"_kept{i}") for i in range(len(kept))]])
    placed = placed.select("_id", "nth", "_n", "leaf", "changed", *[f"_kept{i}" for i in range(len(kept))])

    def of_row(r) -> tuple:
        changed = r[4]
        return (r[0], r[1]), (r[2], r[1] % WIDE, bytes(r[3]), bytes(changed) if changed is not None else None, tuple(r)[5:])

    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps, tasks, roots = _up(placed.rdd.map(of_row), largest, total, least)
    roots.checkpoint()
    roots.count()
    over, over_tasks, top = _up(roots.map(lambda g: ((0, g[0]), (n_groups, g[0] % WIDE, g[1][1], g[1][0]))), n_groups, n_groups, least)
    end, root = top.values().first()
    start = spark.sparkContext.parallelize([(0, (end, None, b""))], 1)
    group_paths = _paths_down(over, start, over_tasks).flatMap(_paths).map(lambda p: (p[0], (p[1][1], p[1][0], p[3])))
    leaves = _paths_down(steps, group_paths, tasks).flatMap(_paths).map(lambda p: (*p[1][2], *p[1][:2], *p[2:]))
    return leaves, root


def manifest(rows: DataFrame, fields: list[str], group: str = "source", order: str = "doc_id", changed: dict[str, Column] | None = None) -> DataFrame:
    """Per row: the order column, leaf, subroot, root, proof (array of hex hashes), proof_sha256, folded_root and verified.

    A row's hash is of ``fields``; ``changed`` names columns as they stand in the copy
    to verify (those left out stand unchanged), whose hashes are folded with the
    manifest's proofs.  ``verified`` tells whether they lead to the root.
    """
    spark = rows.sparkSession
    now = leaf(F.col(f) for f in fields)
    again = leaf((changed or {}).get(f, F.col(f)) for f in fields)
    hashed = rows.select(F.col(group).alias("group"), F.col(order).alias("place"), now.alias("leaf"), again.alias("changed"))
    hashed = hashed.select("group", "place", F.unhex("leaf").alias("leaf"), F.when(F.col("changed") != F.col("leaf"), F.unhex("changed")).alias("changed"))
    leaves, root = tree(hashed, kept=["place"])
    schema = T.StructType([T.StructField(order, rows.schema[order].dataType)] + [T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root")] + [T.StructField("proof", T.ArrayType(T.StringType())), T.StructField("proof_sha256", T.StringType()), T.StructField("folded_root", T.StringType()), T.StructField("verified", T.BooleanType())])

    def shown(row: tuple) -> tuple:
        place, digest, other, subroot, path = row
        proof, end = siblings(path), folded(digest if other is None else other, path)
        return place, digest.hex(), subroot.hex(), root.hex(), [s.hex() for s in proof], parent(proof).hex(), end.hex(), end == root

    return spark.createDataFrame(leaves.map(shown), schema, verifySchema=False)


def verified(rows: DataFrame, proofs: DataFrame, fields: list[str], order: str = "doc_id") -> DataFrame:
    """``rows`` with verified: whether a row's hash is that of a leaf of the manifest ``proofs`` under this id."""
    known = proofs.filter("verified").select(F.col(order).alias("_id"), F.col("leaf").alias("_leaf")).distinct()
    hashed = rows.withColumn("_now", leaf(F.col(f) for f in fields))
    return hashed.join(known.withColumn("_known", F.lit(True)), F.col(order).eqNullSafe(F.col("_id")) & (F.col("_now") == F.col("_leaf")), "left").withColumn("verified", F.coalesce("_known", F.lit(False))).drop("_id", "_leaf", "_now", "_known")
