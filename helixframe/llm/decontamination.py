"""Benchmark decontamination by a broadcast set of normalised n-grams.

Words are runs of ASCII letters and digits and of all characters beyond ASCII,
with A-Z lower-cased.  An item's windows are its runs of ``width`` words; an
item of fewer words is one window.  Windows are broadcast as arrays, in blocks of
about ``max_windows`` and ``max_bytes``; a larger benchmark is scanned block after
block, with the same result.  A hash finds candidates; the words themselves confirm them.

Defined results: a null or empty text has no words and is clean; equal rows get
equal results; an empty benchmark leaves all clean, and an empty table gives no rows; null
item ids count as no item, and items of equal windows are all named; a long text is
scanned whole.  Other columns pass through untouched.
"""

from __future__ import annotations

import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.plans.staging import spread, staged

#: Windows in one broadcast block, and bytes of these and their item ids.
MAX_WINDOWS, MAX_BYTES = 2_000_000, 200_000_000
#: Words that are looked at together.
AT_ONCE = 400_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def _windows(batches, width: int):
    for batch in batches:
        rows, found = [], []
        for i, text in enumerate(batch.column(1)):
            own = words(text.as_py())
            for j in range(max(1, len(own) - width + 1) if own else 0):
                rows.append(i)
                found.append(b" ".join(own[j : j + width]))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.binary())], ["item", "window"])


def item_windows(benchmark: DataFrame, width: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The distinct windows of each item: item (as text), window."""
    given = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).dropna(subset=["item"])
    return given.mapInArrow(lambda b: _windows(b, width), "item string, window binary").distinct()


class Index:
    """Windows by length, as rows of word numbers sorted by hash, each with the items that have it.

    All but the vocabulary is in arrays: a window takes 4 bytes a word and 20 more.
    """

    def __init__(self, given: pa.Table) -> None:
        names = given["item"].combine_chunks().dictionary_encode()
        self.items, item_at = names.dictionary.to_pylist(), names.indices.to_numpy()
        self.numbers: dict[bytes, int] = {}
        number = lambda word: self.numbers.setdefault(word, len(self.numbers) + 1)
        sizes, coded = np.zeros(len(given), np.int64), []
        for begin in range(0, len(given), 10_000):
            split = [window.split(b" ") for window in given["window"].slice(begin, 10_000).to_pylist()]
            sizes[begin : begin + len(split)] = list(map(len, split))
            coded.append(np.fromiter(map(number, chain.from_iterable(split)), np.uint32))
        coded, first = np.concatenate(coded) if coded else np.zeros(0, np.uint32), np.cumsum(sizes) - sizes
        rows = {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}
        seed, self.tables = 7, None
        while self.tables is None:  # until no two windows share a hash
            self.factors = np.random.default_rng(seed).integers(0, 2**63, int(sizes.max(initial=0)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            tables = {n: self._table(coded[first[at][:, None] + np.arange(n)], item_at[at]) for n, at in rows.items()}
            self.tables = None if None in tables.values() else tables
            seed += 1

    def _table(self, coded: np.ndarray, items: np.ndarray):
        """(hashes, windows, where the items of each window start, items), or None if two windows share a hash."""
        value = np.zeros(len(coded), np.uint64)
        for j in range(coded.shape[1]):
            value += coded[:, j] * self.factors[j]
        order = np.argsort(value, kind="stable")
        value, coded, items = value[order], coded[order], items[order]
        again = value[1:] == value[:-1]
        if (coded[1:][again] != coded[:-1][again]).any():
            return None
        own = np.flatnonzero(np.concatenate([[True], ~again]))
        return value[own], coded[own], np.append(own, len(items)), items

    def hits(self, coded: np.ndarray):
        """(position, length, items) of all windows in a row of word numbers; 0 stands for a word of no window."""
        gaps = np.concatenate([[0], np.cumsum(coded == 0)])
        for n, (hashes, windows, starts, items) in self.tables.items():
            at = np.flatnonzero(gaps[n:] == gaps[: len(gaps) - n]) if len(coded) >= n else []
            if not len(at):
                continue
            value = np.zeros(len(at), np.uint64)
            for j in range(n):
                value += coded[at + j] * self.factors[j]
            row = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
            same = np.flatnonzero(hashes[row] == value)
            same = same[(coded[at[same][:, None] + np.arange(n)] == windows[row[same]]).all(1)]
            for p, r in zip(at[same].tolist(), row[same].tolist(), strict=True):
                yield p, n, [self.items[k] for k in items[starts[r] : starts[r + 1]]]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(text: str, spans: list) -> str:
    """``text`` without the words from begin to end of each span, counted as ``words`` does."""
    at, parts, last = [m.span() for m in _WORD.finditer(text)], [], 0
    for begin, end in spans:
        parts.append(text[last : at[begin][0]])
        last = at[end - 1][1]
    return "".join([*parts, text[last:]])


def _scan(batches, shared, text_at: int, names: list[str], first: bool, cut: bool):
    index = shared.value
    number = index.numbers.get
    for batch in batches:
        n_words, spans, items = [], [[] for _ in range(len(batch))], [set() for _ in range(len(batch))]
        block, starts, owners, size = [], [], [], 0

        def look() -> None:
            coded, begin = np.concatenate(block), np.array(starts)
            for p, n, found in index.hits(coded):
                k = int(np.searchsorted(begin, p, "right")) - 1
                spans[owners[k]].append((p - starts[k], p - starts[k] + n))
                items[owners[k]].update(found)

        for i, text in enumerate(batch.column(text_at)):
            own = words(text.as_py())
            n_words.append(len(own))
            block.append(np.fromiter(map(number, own, repeat(0)), np.uint64, len(own)))
            block.append(np.zeros(1, np.uint64))  # no window goes across two texts
            starts.append(size)
            owners.append(i)
            size += len(own) + 1
            if size >= AT_ONCE:
                look()
                block, starts, owners, size = [], [], [], 0
        if block:
            look()
        if not first:
            for i, (old, seen) in enumerate(zip(batch.column(len(names) + 1).to_pylist(), batch.column(len(names) + 2).to_pylist(), strict=True)):
                spans[i] += [tuple(s.values()) for s in old]
                items[i].update(seen)
        pairs = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        spans = [_merged(s) if s else [] for s in spans]
        columns = [batch.column(k) for k in range(len(names))]
        if cut and any(spans):
            text = columns[text_at]
            left = pa.array([_cut(text[i].as_py(), s) for i, s in enumerate(spans) if s], text.type)
            columns[text_at] = pc.replace_with_mask(text, pa.array([bool(s) for s in spans]), left)
        spans = [[{"begin": a, "end": b} for a, b in s] for s in spans]
        out = [pa.array(n_words, pa.int64()), pa.array(spans, pairs), pa.array([sorted(s) for s in items], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns + out, [*names, "n_words", "hit_spans", "hit_items"])


def scan(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    max_windows: int = MAX_WINDOWS, max_bytes: int = MAX_BYTES, cut: bool = False,
) -> DataFrame:
    """``docs`` with n_words, hit_spans (merged runs of hit words), hit_items (ids as text, sorted).

    Columns of these names in ``docs`` are replaced.  With ``cut`` the text is
    without the hit spans, which are counted in the words of the whole text.
    """
    spark = docs.sparkSession
    given = docs.drop("n_words", "hit_spans", "hit_items")
    names = given.columns
    windows = staged(item_windows(benchmark, width, item_id, item_text))
    n, size = windows.agg(F.count("*"), F.sum(F.octet_length("item") + F.octet_length("window"))).first()
    blocks = max(1, -(-n // max_windows), -(-(size or 0) // max_bytes))
    spans = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*given.schema, T.StructField("n_words", T.LongType()), T.StructField("hit_spans", spans), T.StructField("hit_items", T.ArrayType(T.StringType()))])
    out = spread(given)
    for k in range(blocks):
        if k:
            out = staged(out)  # so that a task holds one block
        own = windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k) if blocks > 1 else windows
        shared = spark.sparkContext.broadcast(Index(own.toArrow()))  # a block
        last = cut and k == blocks - 1
        out = out.mapInArrow(lambda b, s=shared, first=not k, last=last: _scan(b, s, names.index(text_col), names, first, last), schema)
    return out


def n_hit() -> Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without contaminated documents, or with the hit spans cut out (``remove="spans"``)."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    found = scan(rows, benchmark, cut=remove == "spans", **how)
    if remove == "documents":
        return found.filter(F.size("hit_spans") == 0).select("row.*")
    return found.select(*[(F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])
