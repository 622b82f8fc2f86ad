import random
from pathlib import Path

from helixframe.llm import line_dedup


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[p + 1 :] == b[p + 1 :] or a[p:] == b[p + 1 :] or a[p + 1 :] == b[p:]


def brute(rows, near_words):
    """Per (id, text): the text left, or None for a document that goes; rows in the operator's order, ids distinct."""
    first = {}
    for doc_id, text in sorted(rows):
        for no, line in enumerate((text or "").split("\n")):
            if words := tuple(line.lower().split()):
                first.setdefault(words, (doc_id, no))
    lost = {a for a, p in first.items() if len(a) >= near_words for b, q in first.items() if len(b) >= near_words and q < p and within_one(a, b)}
    kept = {p for a, p in first.items() if a not in lost}
    out = {}
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        left = [line for no, line in enumerate(lines) if not line.split() or (doc_id, no) in kept]
        gone = any(line.split() for line in lines) and not any(line.split() for line in left)
        out[doc_id] = None if gone else text if text is None else "\n".join(left)
    return {d: t for d, t in out.items() if t is not None or not dict(rows)[d]}


def test_random_lines(spark):
    rng = random.Random(2)
    pool = [[rng.choice("abcdefg") for _ in range(rng.randrange(1, 13))] for _ in range(120)]
    rows = []
    for i in range(150):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            words = list(rng.choice(pool))
            kind = rng.random()
            at = rng.randrange(len(words))
            if kind < 0.3:
                words[at] = rng.choice("hijk")
            elif kind < 0.5:
                words.insert(at, rng.choice("hijk"))
            elif kind < 0.7:
                del words[at]
            lines.append((" " if kind < 0.9 else "\t ").join(words).title())
        rows.append((i, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df, words_per_edit=4).collect()}
    assert got == brute(rows, 4)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    rows = [
        (1, None, 1, "a"), (2, "", 2, "a"), (3, "  \n\n", 3, "b"), (4, "Same line\nown\n\nSAME  line", 4, "b"), (5, "same line", 5, "c"), (6, "same line\nother", 6, "c"),
        (7, "twice\nthe one", 7, None), (7, "twice\nthe one", 7, None), (None, "own\nlast", 9, "d"), (8, long, 1, "e"), (9, long + " more\nx", 1, "e"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_text int, n_lines string")
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"], r["text"], r["kept_text"]) for r in out.collect()), key=str)
    assert got == sorted(
        [(1, None, 1), (2, "", 2), (3, "  \n\n", 3), (4, "Same line\nown\n", 4), (6, "other", 6), (7, "twice\nthe one", 7), (7, "twice\nthe one", 7), (None, "last", 9), (8, long, 1), (9, "x", 1)],
        key=str,
    )
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_native():
    source = Path(line_dedup.__file__).read_text()
    assert not any(x in source for x in ("udf", "mapIn", "applyIn", ".rdd", "toPandas", "import pandas", "pyarrow"))
