import random
import re
from collections import defaultdict

import numpy as np
import pytest

from helixframe.llm import minhash
from helixframe.llm.queries import op7_minhash
from helixframe.plans.components import components


def sets_of(text, width):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not own:
        return frozenset()
    return frozenset(tuple(own[i : i + width]) for i in range(max(1, len(own) - width + 1)))


def brute(docs, width=4, percent=80):
    sets = {d: sets_of(t, width) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            index[g].append(d)
    for d, s in sets.items():
        shared = defaultdict(int)
        for g in s:
            for e in index[g]:
                shared[e] += 1
        for e, n in shared.items():
            if e < d and 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets.items())


def test_query_matches_brute_force(spark):
    at = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in op7_minhash(spark, at).collect())
    assert got == brute(docs)


def test_chains_and_large_groups(spark):
    """Copies with a word changed here and there: links go along chains, in groups of very many."""
    rng = random.Random(4)
    docs = []
    for group in range(6):
        base = [f"w{rng.randrange(4000)}" for _ in range(60 + 10 * group)]
        for _ in range([2, 5, 40, 150, 3, 80][group]):
            docs.append(list(base))
            for _ in range(rng.choice([0, 0, 1, 1])):
                base[rng.randrange(len(base))] = f"n{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                docs.append([*docs[-1][:5], f"n{rng.randrange(10**6)}", *docs[-1][5:]])
    rng.shuffle(docs)
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in minhash.near_duplicates(df, width=4).collect())
    assert got == brute(rows)


def test_edges(spark):
    long = " ".join(f"x{i}" for i in range(30000))
    rows = [(1, None, "q"), (2, "", "q"), (3, " \n\t", "q"), (4, "One two", None), (5, "one  TWO", "z"), (5, "one  TWO", "z"), (None, "one two", "z"), (7, long, "a"), (8, long + " y", "b"), (9, "one", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=str)
    expected = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (7, 29996, 7, True), (8, 29997, 7, False), (9, 1, 9, True)]
    assert [r for r in got if r[0] is not None] == expected
    assert [r[3] for r in got if r[0] is None] == [True]
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "7", "9", "None"]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    both, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (600, 200, 200))
    x, y = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
    got = (minhash.signature(x, 2000) == minhash.signature(y, 2000)).mean()
    assert abs(got - 0.6) < 0.05


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(None, 3), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    parent = {}
    for a, b in edges:
        if a is None or a == b:
            continue
        for x in (a, b):
            parent.setdefault(x, x)
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        parent[max(a, b)] = min(a, b)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ids_of_several_texts_lose_no_text(spark):
    base = [f"w{i}" for i in range(60)]
    a, near, other = " ".join(base), " ".join([*base, "more"]), " ".join(f"v{i}" for i in range(40))
    rows = [(1, a, "x"), (5, near, "y"), (5, other, "z"), (5, other, "z"), (None, a, "n"), (6, None, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, version string")
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["version"]) for r in kept.collect()) == [("1", "x"), ("5", "z"), ("5", "z"), ("6", "m"), ("None", "n")]
    found = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert found[5, 57] == (1, False) and found[5, 36] == (5, True)
