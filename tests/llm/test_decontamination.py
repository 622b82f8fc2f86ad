import hashlib
import re

import numpy as np
import pyarrow as pa

from helixframe.llm import decontamination
from helixframe.llm.queries import op10_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width=10):
    windows = {}
    for item, text in items:
        own = fold(text)
        for j in range(max(1, len(own) - width + 1) if own else 0):
            windows.setdefault(tuple(own[j : j + width]), set()).add(item)
    sizes = {len(w) for w in windows}
    for doc_id, text in docs:
        own, hit, found = fold(text), set(), set()
        for n in sizes:
            for i in range(len(own) - n + 1):
                if (w := tuple(own[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[w]
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        yield doc_id, len(own), len(hit), len(found), digest, bool(hit)


def columns(r):
    return r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]


def test_query_matches_brute_force(spark):
    at = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{at}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [columns(r) for r in op10_decontamination(spark, at).collect()]
    assert sorted(rows) == sorted(brute(docs, items))
    assert any(r[-1] for r in rows)


DOCS = [
    (1, None, 5), (2, "", 5), (3, "One TWO three", 5), (4, "zero one two three four", None), (4, "zero one two three four", None), (None, "a b c d e f g h i j k l a b c d", 1),
    (6, "x " * 50000 + "one-two?three", 0), (7, "één b", 0),
]
ITEMS = [(10, "one two three"), (11, "One, two: three"), (12, None), (13, "..."), (14, "b c d e f g h i j k l"), (None, "zero"), (15, "ÉÉN b")]


def test_edges_and_blocks(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, n_words long")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    key = lambda r: (r[0] is None, r[0] or 0)
    expected = sorted(brute([d[:2] for d in DOCS], [i for i in ITEMS if i[0] is not None]), key=key)
    for most in ({"max_windows": 1000}, {"max_windows": 2}, {"max_bytes": 30}):
        found = decontamination.scan(docs, items, **most)
        rows = found.withColumn("n_hit", decontamination.n_hit()).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], len(r["hit_items"])) for r in rows), key=key) == [e[:4] for e in expected]
    assert decontamination.scan(docs, items.limit(0)).filter("size(hit_spans) > 0").count() == 0
    assert decontamination.scan(docs.limit(0), items).count() == 0


def test_removal(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, n_words long")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontamination.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect())) == [1, 2, 7]
    cut = {r["doc_id"]: r for r in decontamination.decontaminate(docs, items, remove="spans").collect()}
    assert cut[3]["text"] == "" and cut[3]["n_words"] == 5
    assert cut[4]["text"] == "zero  four"
    assert cut[6]["text"] == "x " * 50000


def test_spans_are_cut_after_the_last_block(spark):
    """Spans that several blocks find in a text, of all documents, against the words cut one by one."""
    docs = spark.createDataFrame([(1, "a b, c d e f; g h"), (2, None), (3, "x"), (4, "G-H a")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "b c"), (2, "c d"), (3, "g h")], "item_id long, text string")
    for most in ({}, {"max_windows": 1}, {"max_bytes": 4}):
        left = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(docs, items, remove="spans", width=2, **most).collect()}
        assert left == {1: "a  e f; ", 2: None, 3: "x", 4: " a"}


def test_index_of_windows_with_several_items():
    """Each window once, with all items that have it, whatever the order of the rows."""
    rows = [("b", b"x y"), ("a", b"x y"), ("a", b"y x"), ("c", b"z"), ("c", b"x y")]
    index = decontamination.Index(pa.table({"item": [r[0] for r in rows], "window": pa.array([r[1] for r in rows], pa.binary())}))
    text = [index.numbers.get(w, 0) for w in b"z x y x q y x".split()]
    hits = sorted((p, n, sorted(found)) for p, n, found in index.hits(np.array(text, np.uint64)))
    assert hits == [(0, 1, ["c"]), (1, 2, ["a", "b", "c"]), (2, 2, ["a"]), (5, 2, ["a"])]
    none = decontamination.Index(pa.table({"item": pa.array([], pa.string()), "window": pa.array([], pa.binary())}))
    assert list(none.hits(np.array([0, 0], np.uint64))) == []
