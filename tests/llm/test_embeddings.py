import numpy as np
import pytest

from helixframe.llm import embeddings
from helixframe.llm.queries import op4_embeddings


def brute(rows, threshold=0.9):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v]
    usable = [(i, v / np.abs(v).max()) for i, v in usable if np.isfinite(v).all() and v.any()]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = [0] * len(usable)
    for k, (i, a) in enumerate(usable):
        for m, (j, b) in enumerate(usable[:k]):
            if len(a) == len(b) and a @ b >= threshold * np.linalg.norm(a) * np.linalg.norm(b):
                n[k] += 1
                n[m] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    count = dict(zip((i for i, _ in usable), n, strict=True))
    return sorted((i, count.get(i, 0), find(i), find(i) == i) for i, _ in rows if i is not None)


def test_query_matches_brute_force(spark):
    at = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{at}/embeddings.parquet").collect()]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sim = x @ x.T >= 0.9
    np.fill_diagonal(sim, False)
    got = {r["vec_id"]: r for r in op4_embeddings(spark, at).collect()}
    assert len(got) == len(rows)
    true = {i: int(n) for (i, _), n in zip(rows, sim.sum(1), strict=True)}
    assert all(got[i]["n_links"] <= n for i, n in true.items())
    assert sum(r["n_links"] for r in got.values()) >= 0.995 * sum(true.values())


@pytest.mark.parametrize("dim", [8, 48, 64])
def test_recall_at_the_threshold(dim):
    """Pairs at a cosine just above the threshold meet in some table nearly always."""
    rng = np.random.default_rng(dim)
    hashes, tables = embeddings.chosen_tables(20000, dim, 0.9)
    a, b = rng.normal(size=(2, 1500, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.901 * a + np.sqrt(1 - 0.901**2) * b
    met = np.zeros(len(a), bool)
    for t in range(tables):
        x, y = (embeddings.buckets(embeddings._padded(v), t, hashes) for v in (a, b))
        met |= ((x == y[:, :1]) | (y == x[:, :1])).any(1)
    assert met.mean() > 0.99


def test_edges(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(4, 10))
    rows = [(1, None), (2, []), (3, [0.0] * 10), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (None, [1.0, 2.0])]
    rows += [(9, [-0.0, 1.0]), (10, [0.0, 1.0]), (10, [0.0, 1.0]), (11, [1e-300, 2e-300]), (12, [1e300, 2e300])]
    for k in range(60):
        rows.append((100 + k, (base[k % 4] + 0.15 * rng.normal(size=10)).tolist()))
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<double>, n_links long")
    got = sorted(tuple(r) for r in embeddings.near_duplicates(df).collect() if r["vec_id"] is not None)
    assert got == brute(rows)
    assert [tuple(r)[1:] for r in embeddings.near_duplicates(df).filter("vec_id is null").collect()] == [(0, None, True)]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    assert embeddings.near_duplicates(df.limit(3)).count() == 3
