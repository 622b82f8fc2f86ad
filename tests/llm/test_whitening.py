import math

import numpy as np
import pytest
from pyspark.sql import types as T

from helixframe.llm import whitening
from helixframe.llm.queries import op11_whitening
from helixframe.plans.staging import table

SCHEMA = "vec_id long, embedding array<float>, whitened string, n int"


def brute(rows, components=4, scale=256.0):
    """{(row number, component): (n, deviation, |whitened|, explained)} by plain loops over whole numbers."""
    used = {i: [math.floor(scale * float(c)) for c in v] for i, v in enumerate(rows) if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    listed = sorted(set(map(tuple, used.values())))
    n, sums = len(listed), [sum(c) for c in zip(*listed, strict=True)]
    exact = [[n * c - s for c, s in zip(x, sums, strict=True)] for x in listed]
    centred = np.array(exact, float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in used.items():
        own = [n * c - s for c, s in zip(x, sums, strict=True)]
        for k in range(min(components, len(sums))):
            out[i, k + 1] = n, sum(c * c for c in own), abs(np.array(own, float) / n @ vectors[:, k]) / math.sqrt(values[k]), values[k] / values.sum()
    return out


def test_whole_table(spark, tiny):
    got = {(r["vec_id"], r["component"]): r for r in op11_whitening(spark, tiny).collect()}
    given = table(spark, tiny, "embeddings").collect()
    want = brute([r["embedding"] for r in given])
    assert len(got) == len(want)
    for (i, k), (n, deviation, size, explained) in want.items():
        r = got[given[i]["vec_id"], k]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["whitened"]) == pytest.approx(size, rel=1e-7, abs=1e-9)
        assert r["explained"] == pytest.approx(explained, rel=1e-9)
        assert r["identity_error"] < 1e-9


def test_edges(spark):
    rng = np.random.default_rng(1)
    vectors = [rng.normal(size=3).astype("float32").tolist() for _ in range(40)]
    rows = [(i, v, "x", 7) for i, v in enumerate(vectors)] + [(None, vectors[0], None, None), (3, vectors[3], "x", 7), (3, vectors[3], "x", 7)]
    rows += [(90, None, "x", 7), (91, [1.0, None, 2.0], "x", 7), (92, [1.0, math.nan, 2.0], "x", 7), (93, [1.0, math.inf, 2.0], "x", 7), (94, [], "x", 7), (95, [1.0, 2.0], "x", 7), (96, [1.0, 2.0], "x", 7)]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["vec_id"] for r in got} == {*range(40), None, 95, 96}
    assert {r["n"] for r in got if r["vec_id"] not in (95, 96)} == {40}  # equal vectors count once
    assert sum(r["vec_id"] == 3 for r in got) == 9  # three rows of three components
    flat = [r for r in got if r["vec_id"] in (95, 96)]  # another length, one distinct vector
    assert len(flat) == 4 and all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (1, 0, None, 0.0, 0.0) for r in flat)
    want = brute(vectors, components=3)
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert all(abs(by[i, k]["whitened"]) == pytest.approx(w, rel=1e-7) and by[i, k]["deviation"] == d for (i, k), (_, d, w, _) in want.items())


def test_flat_components(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0], "x", 1) for i in range(6)]
    got = {(r["vec_id"], r["component"]): r for r in whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 18 and all((r["whitened"] is None) == (k > 1) for (_, k), r in got.items())
    assert got[0, 1]["explained"] == pytest.approx(1) and got[0, 2]["explained"] == 0
    assert abs(got[5, 1]["whitened"]) == pytest.approx(abs(5 - 2.5) / np.std(range(6)))


def test_wide_numbers_stay_exact(spark):
    rows = [(1, [1e17, -3.0]), (2, [-1e17, 4.0]), (3, [4e17, 0.5])]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    xs = {1: (10**17, -3), 2: (-(10**17), 4), 3: (4 * 10**17, 0)}
    sums = [sum(c) for c in zip(*xs.values(), strict=True)]
    for rows_, known in ((rows, xs), ([*rows, (4, [1e300, 0.0])], {})):  # beyond 38 digits: null
        got = {r["vec_id"]: r["deviation"] for r in whitening.whitened(spark.createDataFrame(rows_, schema), scale=1.0).filter("component = 1").collect()}
        assert all(int(got[i]) == sum((3 * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for i, x in known.items())
    assert got[4] is None and len(got) == 4


def test_empty(spark):
    got = whitening.whitened(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
