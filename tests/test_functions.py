"""Hand-worked cases of the expressions and metrics."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helixframe.functions import columns as C
from helixframe.functions import metrics as M
from helixframe.functions import vectors as V
from helixframe.functions.scales import EVIDENCE, FIGURES, scale_table


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


@pytest.mark.parametrize(
    ("counts", "odds"), [((2, 1, 1, 2), 4.0), ((2, 0, 1, 3), math.inf), ((0, 0, 3, 3), 0.0), ((0, 2, 1, 1), 0.0)]
)
def test_odds_ratio(spark, counts, odds):
    df = one(spark, tp=counts[0], fp=counts[1], fn=counts[2], tn=counts[3])
    assert df.select(M.odds_ratio(*(F.col(c) for c in df.columns))).first()[0] == odds


def test_fisher(spark):
    rows = [(3.0, 1.0, 1.0, 3.0), (0.0, 0.0, 5.0, 5.0), (354.53, 845.29, 9.3, 21025.73)]
    df = spark.createDataFrame(rows, ["tp", "fp", "fn", "tn"])
    cells = [F.col(c) for c in df.columns]
    got = df.select(M.fisher_greater(*cells), M.truncated_odds_ratio(*cells)).collect()
    assert abs(got[0][0] - 17 / 70) < 1e-9 and got[0][1] == 9
    assert got[1][0] == 1.0 and got[1][1] is None
    assert got[2][0] < 1e-300 and abs(got[2][1] - 978.6785) < 1e-3


def test_expected_overlap_and_cohen_d(spark):
    df = one(spark, a=3, m=3, tp=2, n=6)
    assert abs(df.select(M.expected_overlap(*(F.col(c) for c in df.columns))).first()[0] - 1.4) < 1e-12
    assert one(spark, a=1, m=1, tp=1, n=1).select(M.expected_overlap(*(F.col(c) for c in ("a", "m", "tp", "n")))).first()[0] is None
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (0, 0.0), (0, 0.0), (0, 2.0)], "i int, v double")
    i, o = F.when(F.col("i") == 1, F.col("v")), F.when(F.col("i") == 0, F.col("v"))
    d = df.agg(F.avg(i).alias("mi"), F.stddev_pop(i).alias("si"), F.avg(o).alias("mo"), F.stddev_pop(o).alias("so")).select(M.cohen_d(*(F.col(c) for c in ("mi", "si", "mo", "so")))).first()[0]
    assert abs(d - 1.371989) < 1e-6


def test_columns(spark):
    df = one(spark, s=3, e=7, n=10, t="abcdefghij", x=float("inf"))
    row = df.select(
        C.interval_length(F.col("s"), F.col("e")), C.interval_length(F.col("e"), F.col("s")), C.relative_midpoint(F.col("s"), F.col("e"), F.col("n")), C.relative_midpoint(F.col("s"), F.col("e"), F.lit(0)),
        C.density(F.col("s"), F.lit(0)), C.truncated(F.col("t"), 4), C.truncated(F.col("t"), 10), C.finite_or(F.col("x"), 200.0), C.finite_or(F.lit(7.5), 200.0), C.harmonic(F.lit(0.9), F.lit(0.3)),
        C.harmonic(F.lit(0.0), F.lit(0.0)), C.none_if_nan(F.lit(float("nan"))), C.clipped(F.col("n"), 12), C.clipped(F.col("n"), high=4), C.labelled(F.lit("A Helix turn"), [("helix", "H"), ("turn", "T")], "O"),
        C.alphabet_only(F.lit("ACD"), "ACD"), C.alphabet_only(F.lit("AXD"), "ACD"),
    ).first()
    assert list(row) == [5, 5, 0.5, None, 300.0, "abcd…", "abcdefghij", 200.0, 7.5, pytest.approx(0.45), 0.0, None, 12, 4, "H", True, False]


def test_histogram_bins_close_the_last(spark):
    df = spark.createDataFrame([(x,) for x in (-0.1, 0.0, 0.49, 0.5, 1.0, 1.1)], "x double")
    assert [r[0] for r in df.select(C.histogram_bin(F.col("x"), 0.0, 1.0, 2)).collect()] == [None, 0, 0, 1, 1, None]


def test_min_max(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, 6.0), (2, 5.0)], "g int, v double")
    got = df.select("g", "v", C.min_max(F.col("v"), Window.partitionBy("g")).alias("s")).orderBy("g", "v").collect()
    assert [round(r["s"], 6) for r in got] == [0.0, 0.5, 1.0, 0.0]


def test_vectors(spark):
    df = one(spark, a=[1.0, -2.0], b=[3.0, 4.0], z=[0.0, 0.0])
    row = df.select(V.dot("a", "b"), V.norm("b"), V.cosine("a", "z"), V.relu("a"), V.standardized(F.col("b"), F.array(F.lit(1.0), F.lit(4.0)), F.array(F.lit(2.0), F.lit(0.0)))).first()
    assert list(row) == [-5.0, 5.0, None, [1.0, 0.0], [1.0, 0.0]]


def test_scales(spark):
    for scales, n in ((EVIDENCE, 7), (FIGURES, 8)):
        assert len(scales) == n and all(len(v) == 20 for v in scales.values())
        assert scale_table(spark, scales).count() == 20 * n
    value = {(r["residue"], r["property"]): r["value"] for r in scale_table(spark).collect()}
    assert value["R", "charge"] == 1 and value["D", "charge"] == -1 and value["W", "aromaticity"] == 1 and value["H", "aromaticity"] == 0 and value["I", "hydrophobicity"] == 4.5
    assert value["W", "disorder_prop"] == -0.884 and value["P", "helix_prop"] == 3.16 and value["Y", "volume"] == 193.6
