import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import selection as S


def turns(types, scores):
    """Types one by one, best first, each with its first free feature of two."""
    taken, out = set(), {}
    for t, _ in sorted(types.items(), key=lambda x: (-x[1], x[0])):
        for _, f in sorted((-s, f) for f, u, s in scores if u == t)[:2]:
            if f not in taken:
                taken.add(f)
                out[t] = f
                break
    return out


@pytest.mark.parametrize("seed", range(3))
def test_owners(spark, seed):
    rng = random.Random(seed)
    scores = [(f, f"t{t}", rng.randint(1, 6) / 7) for t in range(14) for f in rng.sample(range(8), rng.randint(1, 5))]
    types = {t: max(s for _, u, s in scores if u == t) for t in {u for _, u, _ in scores}}
    got = S.owners(spark.createDataFrame(list(types.items()), "annot_type string, best double"), spark.createDataFrame(scores, "feature_id long, annot_type string, auprc_mean double"))
    assert {r["annot_type"]: r["feature_id"] for r in got.collect()} == turns(types, scores)


def test_described_falls_back(spark):
    schema = "feature_type string, annot_subtype string"
    finer = spark.createDataFrame([("a", "a"), ("a", "a: x"), ("b", None)], schema)
    assert [r["annot_subtype"] for r in S.described(finer).collect()] == ["a: x"]
    plain = spark.createDataFrame([("a", "a"), ("b", None)], schema)
    assert S.described(plain).count() == 2 and S.described(plain.limit(0)).count() == 0


def test_robust_types_without_clusters(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "annot_type string, x int")
    summary = spark.createDataFrame([("a", 5), ("b", 4)], "annot_type string, n_proteins int")
    assert [r["x"] for r in S.of_robust_types(rows, summary).collect()] == [1]


def test_figure_types(spark):
    scores = spark.createDataFrame(
        [(1, "p: a", 0.6), (1, "p: b", 0.7), (2, "q", 0.5), (1, "r", 0.96), (2, "r", 0.97), (1, "s: a", 0.9), (1, "s : b", 0.9)], "feature_id long, annot_type string, auprc_mean double"
    )
    assert sorted(r["annot_type"] for r in S.figure_types(scores, most=1).collect()) == ["p: b", "s : b"]


def test_histogram_edges(spark):
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    counts = lambda df: {r["bin"]: r["n"] for r in df.collect()}
    assert counts(S.histogram(rows(1, 1, 41, None), "v")) == {0: 2, 39: 1}
    assert counts(S.histogram(rows(7, 7), "v")) == {0: 2}
    assert counts(S.histogram(rows(1, 2, 1000), "v")) == {0: 1, 48: 1}  # 1 lies below the first edge
    assert counts(S.histogram(rows(), "v")) == {}


def test_anchored_and_magnitude(spark):
    rows = spark.createDataFrame([("layer_01_to", -3.0), ("x layer_01_to", 2.0), ("layer_a_to", None)], "name string, d double")
    assert [r["name"] for r in rows.filter(S.anchored("name", r"layer_\d+_to")).collect()] == ["layer_01_to"]
    assert [r["d"] for r in S.by_magnitude(rows, "d", "name", 2).collect()] == [-3.0, 2.0]
    assert rows.filter(F.col("d") > 9).count() == 0
