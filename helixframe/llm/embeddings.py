"""Near-duplicate vectors by cross-polytope hashing.

A vector is rotated by random signs and fast Hadamard transforms, three times
over; its hash is the axis that it then lies closest to.  A bucket is the hashes
of a few rotations together.  Each vector stands in one bucket of each table and
probes the next likely ones too; pairs that meet are compared by 128 sign bits,
then by their cosine in double precision.

The number of hashes in a bucket follows the number of vectors, so buckets stay
small, and the number of tables follows from the chance that two vectors just at
the threshold meet in one table, which is measured on random pairs.

Equal vectors are one class with a count, so a common vector costs as much as
one.  What is left grows with the links between different vectors, which are
what is asked for.

Defined results: a null vector or one that is zero, empty, or holds null, NaN or
infinite components links with nothing, and vectors of different lengths don't
link; rows of a null id link with nothing and are kept; rows of one id and
vector count each other as links; other columns are ignored; an empty table
gives no rows; long vectors are compared whole; of equally near hashes the first is
probed.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.plans.components import components
from helixframe.plans.staging import broadcast_if_small, spread, staged

#: Probability that a pair at the threshold meets in some table.
RECALL = 0.998
#: Buckets that a vector probes in each table.
PROBES = 6
SKETCH = 128


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, whose length is a power of two."""
    x = x.copy()
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        a, b = y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]
        y[:, :, 0], y[:, :, 1] = a, b
        h *= 2
    return x


def _rotated(x: np.ndarray, seed: int) -> np.ndarray:
    signs = np.random.default_rng(seed).integers(0, 2, (3, x.shape[1])) * 2.0 - 1
    for s in signs:
        x = _hadamard(x * s)
    return x


def _padded(x: np.ndarray) -> np.ndarray:
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    return np.pad(x, ((0, 0), (0, d - x.shape[1])))


def buckets(x: np.ndarray, table: int, hashes: int, probes: int = PROBES) -> np.ndarray:
    """For each row its bucket and the next likely ones, as (rows, probes) codes."""
    d = x.shape[1]
    choices, gaps = [], []
    for k in range(hashes):
        y = _rotated(x, 1000 * table + k)
        y = np.concatenate([y, -y], 1)
        top = np.argpartition(-y, min(probes, 2 * d - 1), 1)[:, :probes]
        value = np.take_along_axis(y, top, 1)
        order = np.argsort(-value, 1, kind="stable")
        choices.append(np.take_along_axis(top, order, 1))
        value = np.take_along_axis(value, order, 1)
        gaps.append((value[:, :1] - value) ** 2)
    # The first combinations by the sum of their gaps; a rank r can only be among them if (r0 + 1) * (r1 + 1) ... <= probes.
    combos = [c for c in product(range(min(probes, 2 * d)), repeat=hashes) if np.prod([r + 1 for r in c]) <= probes]
    cost = np.stack([sum(gaps[k][:, c[k]] for k in range(hashes)) for c in combos], 1)
    code = np.stack([sum(choices[k][:, c[k]].astype(np.int64) * (2 * d) ** k for k in range(hashes)) for c in combos], 1)
    best = np.argsort(cost, 1, kind="stable")[:, :probes]
    return np.take_along_axis(code, best, 1)


def chosen_tables(n: int, dim: int, threshold: float, recall: float = RECALL, probes: int = PROBES) -> tuple[int, int]:
    """(hashes in a bucket, tables) for ``n`` vectors of ``dim`` components."""
    d = 1 << max(1, (dim - 1).bit_length())
    hashes = max(1, round(np.log(max(n, 2)) / np.log(2 * d)))
    rng = np.random.default_rng(5)
    a = rng.normal(size=(2000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(2000, dim))
    b -= (a * b).sum(1, keepdims=True) * a
    norm = np.linalg.norm(b, axis=1, keepdims=True)
    b = threshold * a + np.sqrt(max(0.0, 1 - threshold**2)) * b / np.where(norm > 0, norm, 1)
    met = []
    for table in range(6):
        x, y = buckets(_padded(a), table, hashes, probes), buckets(_padded(b), table, hashes, probes)
        met.append(((x == y[:, :1]) | (y == x[:, :1])).any(1).mean())
    chance = min(max(float(np.mean(met)), 1e-4), 0.999)
    return hashes, int(np.ceil(np.log(1 - recall) / np.log(1 - chance)))


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Each usable vector in double precision, else None."""
    out = []
    for v in column:
        v = v.as_py()
        x = np.array(v, float) + 0.0 if v and None not in v else None  # -0.0 becomes 0.0
        out.append(x if x is not None and np.isfinite(x).all() and x.any() else None)
    return out


def _digests(batches):
    for batch in batches:
        high, low, dims = [], [], []
        for x in _vectors(batch.column(1)):
            digest = np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), "<i8") if x is not None else (None, None)
            high.append(digest[0] if x is None else int(digest[0]))
            low.append(digest[1] if x is None else int(digest[1]))
            dims.append(0 if x is None else len(x))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(dims, pa.int32())], ["vec_id", "vec", "high", "low", "dim"])


def _unit(rows: list[np.ndarray]) -> np.ndarray:
    x = np.stack(rows)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(batches, dim: int, hashes: int, tables: int):
    rng = np.random.default_rng(9)
    planes = rng.normal(size=(dim, SKETCH))
    for batch in batches:
        if not len(batch):
            continue
        x = _unit(_vectors(batch.column(1)))
        bits = np.packbits(x @ planes > 0, axis=1).view("<i8")
        padded = _padded(x)
        codes = np.stack([buckets(padded, t, hashes) for t in range(tables)], 1)  # rows, tables, probes
        keys = codes * tables + np.arange(tables)[None, :, None]
        lists = pa.array(keys.reshape(len(x), -1).tolist(), pa.list_(pa.int64()))
        own = pa.array(keys[:, :, 0].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits[:, 0]), pa.array(bits[:, 1]), own, lists], ["rep", "s1", "s2", "own", "probed"])


def _confirmed(batches, threshold: float):
    for batch in batches:
        if not len(batch):
            continue
        a, b = _unit(_vectors(batch.column(2))), _unit(_vectors(batch.column(3)))
        at = pa.array(np.flatnonzero((a * b).sum(1) >= threshold))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])


def links(classes: DataFrame, dim: int, threshold: float, n: int, recall: float = RECALL) -> DataFrame:
    """The links (a, b), a < b, found between the classes (rep, vec) of vectors of one length."""
    hashes, tables = chosen_tables(n, dim, threshold, recall)
    kind = classes.schema["rep"].dataType
    keys = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("rep", kind), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("own", keys), T.StructField("probed", keys)])
    hashed = staged(spread(classes.select("rep", "vec")).mapInArrow(lambda b: _hashed(b, dim, hashes, tables), schema))
    own = hashed.select(F.col("rep").alias("a"), F.col("s1").alias("a1"), F.col("s2").alias("a2"), F.explode("own").alias("bucket"))
    probing = hashed.select(F.col("rep").alias("b"), "s1", "s2", F.explode("probed").alias("bucket"))
    # Bits that differ between two vectors at the threshold: a binomial count; more than 6 deviations above the mean is as good as never.
    share = np.arccos(threshold) / np.pi
    most = int(SKETCH * share + 6 * np.sqrt(SKETCH * share * (1 - share)))
    differing = F.bit_count(F.col("s1").bitwiseXOR(F.col("a1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("a2")))
    met = own.join(probing, "bucket").filter((F.col("a") != F.col("b")) & (differing <= most))
    pairs = staged(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    both = pairs.join(classes.select(F.col("rep").alias("a"), F.col("vec").alias("va")), "a").join(classes.select(F.col("rep").alias("b"), F.col("vec").alias("vb")), "b")
    out = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    return both.select("a", "b", "va", "vb").mapInArrow(lambda x: _confirmed(x, threshold), out)


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, recall: float = RECALL, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links (other vectors linked), component_id (least id reachable), kept (whether that is the row's own)."""
    given = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    kind = given.schema["vec_id"]
    schema = T.StructType([kind, given.schema["vec"], T.StructField("high", T.LongType()), T.StructField("low", T.LongType()), T.StructField("dim", T.IntegerType())])
    rows = staged(spread(given).mapInArrow(_digests, schema))
    usable = rows.filter("dim > 0 and vec_id is not null")
    # Vectors that several rows have; a vector that many rows have can be split over tasks in these joins.
    several = usable.groupBy("high", "low").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")).filter("size > 1")
    several = broadcast_if_small(staged(several))
    used = (F.col("dim") > 0) & F.col("vec_id").isNotNull()
    rep, size = F.when(used, F.coalesce("rep", "vec_id")).alias("rep"), F.when(used, F.coalesce("size", F.lit(1))).alias("size")
    members = rows.drop("vec").join(several, ["high", "low"], "left").select("vec_id", rep, size)
    classes = usable.join(several, ["high", "low"], "left").filter("rep is null or rep = vec_id")
    classes = staged(classes.select(rep, "vec", "dim", size, "high", "low").dropDuplicates(["rep", "high", "low"]).drop("high", "low"))
    found = None
    for r in classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect():  # a row for each length of vectors
        part = links(classes.filter(F.col("dim") == r["dim"]), r["dim"], threshold, r["n"], recall)
        found = part if found is None else found.unionAll(part)
    if found is None:
        return members.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = staged(found)
    size = classes.select(F.col("rep").alias("other"), "size")
    ends = found.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionAll(found.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    linked = ends.join(size, "other").groupBy("rep").agg(F.sum("size").alias("linked"))
    reached = components(found).withColumnRenamed("node", "rep")
    component = F.coalesce("component", "rep", "vec_id")
    return members.join(linked, "rep", "left").join(reached, "rep", "left").select(
        "vec_id",
        F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce(F.col("size") - 1, F.lit(0)) + F.coalesce("linked", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
