"""Near-duplicate documents by circulant MinHash.

A document is its set of distinct word shingles.  One permutation scatters the
shingles over a circle of 2^32 places and a second one, shifted circularly by
k, ranks them: the least rank is coordinate k of the signature, so two
permutations give all coordinates.  Bands of coordinates propose pairs; the full
sets confirm them.

Documents with equal sets are one class.  In each band bucket the classes are
first compared with the bucket's least one.  Connected components of the
confirmed links follow; then the classes that share a bucket but not a component
are compared.  Of these, pairs are left out that cannot be similar enough: dealt
out over parts by hash, two sets have in common at most the lesser of their
counts in each part, shingles that no other document there has left aside.  So a large group costs about one comparison for each member
while no proposed link between components is lost.

Defined results: A-Z are lower-cased; a null or empty text, or one of white
space, has no shingles and links with nothing; a text of fewer words than a
shingle is one shingle; equal rows get equal results; if an id has several
texts, each is a document and each row gets the component of its own text; a row
with a null id links with nothing and is kept; a long text is read whole; an empty
table gives no rows; other columns are ignored, or kept by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.memory import Remembered, held
from helixframe.plans.components import components
from helixframe.plans.staging import broadcast_if_small, spread, staged

#: Bands and coordinates in each: a pair at a similarity of 0.8 is missed by all with a probability of 3e-6.
BANDS, ROWS = 24, 4
#: Parts that shingles are dealt out over to bound what two sets have in common; divides 2^64.
PARTS = 64
#: Bytes of words and their hashes that a worker remembers.
REMEMBERED = 80_000_000

_U64, _U32 = np.uint64, np.uint32
_FACTORS = np.random.default_rng(11).integers(0, 2**63, 64, dtype=np.uint64) * _U64(2) + _U64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers."""
    x = x ^ (x >> _U64(32))
    x *= _U64(0xD6E8FEB86659FD93)
    x ^= x >> _U64(32)
    x *= _U64(0xD6E8FEB86659FD93)
    x ^= x >> _U64(32)
    return x


def _word_hashes(words: list[bytes]) -> np.ndarray:
    known = held("minhash", lambda: Remembered(xxhash.xxh3_64_intdigest, REMEMBERED))
    return np.fromiter(map(known.__getitem__, words), _U64, len(words))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    own = _word_hashes((text or "").encode().lower().split())
    n = len(own)
    if not n:
        return own
    size = min(n, width)
    value = np.full(n - size + 1, (width - size) * 0x9E3779B97F4A7C15 % 2**64, _U64)
    for j in range(size):
        value += own[j : n - size + 1 + j] * _FACTORS[j]
    return np.unique(_mixed(value))


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates: the least value of the shifted second permutation over the scattered shingles."""
    places = (_mixed(shingles ^ _U64(0x5851F42D4C957F2D)) >> _U64(32)).astype(_U32)
    shifts = np.arange(size, dtype=_U32)[:, None]
    least = np.full(size, 2**32 - 1, _U32)
    for at in range(0, len(places), 1024):
        x = places[None, at : at + 1024] + shifts
        x ^= x >> _U32(16)
        x *= _U32(0x7FEB352D)
        x ^= x >> _U32(15)
        x *= _U32(0x846CA68B)
        x ^= x >> _U32(16)
        np.minimum(least, x.min(1), out=least)
    return least


def band_keys(shingles: np.ndarray) -> np.ndarray:
    coords = signature(shingles, BANDS * ROWS).astype(_U64).reshape(BANDS, ROWS)
    value = np.arange(1, BANDS + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        value = _mixed(value + coords[:, j] * _FACTORS[j])
    return value.view(np.int64)


def _features(batches, width: int):
    for batch in batches:
        sizes, high, low, bands = [], [], [], []
        for text in batch.column(2):
            own = shingle_set(text.as_py(), width)
            sizes.append(len(own))
            digest = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), "<i8")
            high.append(int(digest[0]))
            low.append(int(digest[1]))
            bands.append(band_keys(own) if len(own) else [])
        out = [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(out, ["doc_id", "version", "n_shingles", "high", "low", "bands"])


def _confirm(batches, width: int, percent: int):
    last: tuple = ("", np.zeros(0, _U64))
    for batch in batches:
        a, b, at, bt = batch.columns
        keep = []
        for i, (text, other) in enumerate(zip(at, bt, strict=True)):
            if last[0] != (own := text.as_py()):  # the join brings pairs of one hub together
                last = (own, shingle_set(own, width))
            mine, its = last[1], shingle_set(other.as_py(), width)
            common = len(np.intersect1d(mine, its, assume_unique=True))
            if common and 100 * common >= percent * (len(mine) + len(its) - common):
                keep.append(i)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([a.take(at), b.take(at)], ["a", "b"])


def _shingles(batches, width: int):
    """node and shingle, a row for each shingle of each text."""
    for batch in batches:
        nodes, texts = batch.columns
        for i, text in enumerate(texts):
            own = shingle_set(text.as_py(), width)
            if len(own):
                node = nodes.take(pa.array(np.full(len(own), i)))
                yield pa.RecordBatch.from_arrays([node, pa.array(own.view(np.int64))], ["node", "shingle"])


def _counts(batches, width: int):
    """node and how many shingles of its text fall into each part."""
    for batch in batches:
        parts = [np.bincount((shingle_set(text.as_py(), width) % _U64(PARTS)).astype(int), minlength=PARTS) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(pa.int32()))], ["node", "parts"])


def shared_parts(texts: DataFrame, width: int) -> DataFrame:
    """node, parts: how many shingles of a node's set that some other row of ``texts`` has fall into each part."""
    made = lambda name, kind: T.StructType([T.StructField("node", texts.schema["node"].dataType), T.StructField(name, kind)])
    rows = texts.mapInArrow(lambda b: _shingles(b, width), made("shingle", T.LongType()))
    once = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).filter("n = 1")
    own = once.groupBy("node", F.pmod(F.col("shingle"), F.lit(PARTS)).cast("int").alias("part")).agg(F.count("*").cast("int").alias("n"))
    own = own.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("own"))  # at most PARTS entries
    counts = texts.mapInArrow(lambda b: _counts(b, width), made("parts", T.ArrayType(T.IntegerType()))).dropDuplicates(["node"])
    left = F.transform("parts", lambda n, p: n - F.coalesce(F.try_element_at("own", p), F.lit(0)))
    return counts.join(own, "node", "left").select("node", left.alias("parts"))


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b), which are staged, whose full shingle sets are similar enough; ``texts`` has node and text."""
    hubs = broadcast_if_small(pairs.select(F.col("a").alias("node")).distinct(), of=pairs)
    first = texts.join(hubs, "node", "left_semi")
    second = texts.join(broadcast_if_small(pairs), texts["node"] == pairs["b"]).select("a", "b", F.col("text").alias("b_text"))
    both = first.withColumnsRenamed({"node": "a", "text": "a_text"}).join(second, "a").select("a", "b", "a_text", "b_text")
    kind = pairs.schema["a"].dataType
    return both.mapInArrow(lambda x: _confirm(x, width, percent), T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least id reachable by links), kept (whether that is the row's own)."""
    return _labelled(docs, width, percent, id_col, text_col).drop("version")


def _labelled(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """As ``near_duplicates``, with version, the hash of the text."""
    text = F.col(text_col).cast("string")
    given = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    long = T.LongType()
    schema = T.StructType([given.schema["doc_id"], T.StructField("version", long), T.StructField("n_shingles", long), T.StructField("high", long), T.StructField("low", long), T.StructField("bands", T.ArrayType(long))])
    features = staged(spread(given).mapInArrow(lambda b: _features(b, width), schema))

    # A node of the graph is a document: its id, and the text as well if some id has several.
    versions = features.dropna(subset=["doc_id"]).groupBy("doc_id").agg(F.min("version").alias("one"), F.max("version").alias("other"))
    several_texts = not versions.filter("one != other").isEmpty()
    node = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "version")) if several_texts else F.col("doc_id")
    features = features.withColumn("node", node)
    texts = given.dropna(subset=["doc_id"]).select(node.alias("node"), "text")

    linked = features.filter("n_shingles > 0 and doc_id is not null").drop("doc_id", "version")
    # Sets that several rows have, and the least node of each; a set that many rows have can be split over tasks in these joins.
    several = linked.groupBy("high", "low").agg(F.min("node").alias("rep"), F.count("*").alias("n")).filter("n > 1").drop("n")
    several = broadcast_if_small(staged(several))
    rep = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("rep", "node"))
    members = features.drop("bands").join(several, ["high", "low"], "left").withColumn("rep", rep)
    own = linked.join(several, ["high", "low"], "left").filter("rep is null or rep = node")
    rows = own.select("node", "n_shingles", F.explode("bands").alias("key"))
    hubs = rows.groupBy("key").agg(F.min(F.struct("node", "n_shingles")).alias("hub"), F.max("node").alias("last")).filter("last != hub.node")
    buckets = staged(rows.join(hubs.select("key", "hub"), "key"))

    def alike(x: str, y: str):
        """Sets of so different sizes can't be similar enough."""
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    pairs = staged(buckets.filter(F.col("node") != F.col("hub.node")).filter(alike("n_shingles", "hub.n_shingles")).select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct())
    links = staged(confirmed(pairs, texts, width, percent))
    found = components(links)

    def mixed(rows: DataFrame) -> DataFrame:
        """The rows of buckets with several components, and the first of these."""
        several = rows.groupBy("key").agg(F.min("component").alias("first"), F.max("component").alias("other")).filter("first != other")
        return rows.join(several.select("key", "first"), "key")

    component = F.coalesce("component", "node").alias("component")
    open_ = staged(mixed(buckets.join(found, "node", "left").select("key", "node", "n_shingles", component)).drop("first"))
    ids = staged(open_.select("node").distinct())
    shared = shared_parts(texts.join(broadcast_if_small(ids), "node", "left_semi"), width)
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, n: s + n)
    alive = open_.join(shared, "node").withColumn("common", total("parts")).filter(100 * F.col("common") >= percent * F.col("n_shingles"))
    alive = staged(mixed(alive))
    probes = alive.filter("component != first").select("key", *[F.col(c).alias(f"p_{c}") for c in ("node", "n_shingles", "component", "common", "parts")])
    bound = lambda common: (100 + percent) * common >= percent * (F.col("n_shingles") + F.col("p_n_shingles"))
    other = F.col("p_component") != F.col("component")
    parts = total(F.zip_with("parts", "p_parts", lambda a, b: F.least(a, b)))
    met = probes.join(alive, "key").filter(other & bound(F.least("common", "p_common")) & bound(parts))
    across = met.select(F.least("p_node", "node").alias("a"), F.greatest("p_node", "node").alias("b")).distinct()
    more = confirmed(staged(across.join(pairs, ["a", "b"], "left_anti")), texts, width, percent)
    found = components(links.unionAll(more)).withColumnRenamed("node", "rep")

    component = F.coalesce("component", "rep", "node")
    return (
        members.join(found, "rep", "left")
        .select("doc_id", "version", "n_shingles", (component["doc_id"] if several_texts else component).alias("component_id"), F.coalesce(F.col("node") == component, F.lit(True)).alias("kept"))
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document, that of the least id (and text hash, if that id has several), of each group of near duplicates."""
    gone = _labelled(docs, width, percent, id_col, text_col).filter("not kept").select(F.col("doc_id").alias("gone_id"), "version").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("own"))
    return rows.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("own") == F.col("version")), "left_anti").select("row.*")
