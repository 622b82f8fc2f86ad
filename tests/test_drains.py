"""Runs that stop, fail, are sharded, and go on."""

import pytest
from pyspark.sql import functions as F

from helixframe.operators import alignment as A
from helixframe.operators import drains

SCORED = "accession long, feature_id long, annot_type string, cluster_id long, ap double, enrichment double, tp long, fp long, fn long, tn long"


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(i, i % 3, "AB"[i % 2], i % 5, (i * 37 % 100) / 100, None if i % 11 == 0 else 1.0 + i % 4, 1 + i % 7, i % 5, i % 3, 50 + i) for i in range(120)]
    return spark.createDataFrame(rows, SCORED).cache()


def rows(df):
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(sorted(df.columns)).collect())


def states(scored, seen=None):
    def score(part):
        if seen is not None:
            seen.append(part.count())
        return A.cluster_states(scored.join(part.select("accession"), "accession", "left_semi"))

    return score


def test_stopped_and_taken_up(spark, scored, tmp_path):
    """Killed after drain 3, with half of drain 4 written, a run gives the rows of one in one go."""
    folder, proteins, calls = str(tmp_path / "d"), scored.select("accession"), []

    def failing(part):
        if len(calls) == 3:
            drains._write(A.cluster_states(scored).withColumns({"shard": F.lit(0), "drain": F.lit(3)}), f"{folder}/states")  # what an attempt left behind
            raise RuntimeError("lost")
        calls.append(1)
        return states(scored)(part)

    with pytest.raises(RuntimeError):
        drains.run(proteins, failing, folder, n_drains=6)
    assert [r["drain"] for r in drains.commits(spark, folder).orderBy("drain").collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        drains.merged(spark, folder)
    seen = []
    assert drains.run(proteins, states(scored, seen), folder, n_drains=6) == 3
    assert sum(seen) + sum(r["n"] for r in drains.commits(spark, folder).filter("drain < 3").collect()) == 120
    assert rows(drains.merged(spark, folder)) == rows(A.by_cluster(scored))
    assert drains.run(proteins, failing, folder, n_drains=6) == 0  # nothing is left to score


def test_later_keys_get_a_drain_of_their_own(spark, scored, tmp_path):
    folder = str(tmp_path / "d")
    drains.run(scored.filter("accession < 90").select("accession"), states(scored), folder, n_drains=3)
    assert drains.run(scored.select("accession"), states(scored), folder, n_drains=3) == 1
    assert rows(drains.merged(spark, folder)) == rows(A.by_cluster(scored))


def test_shards(spark, scored, tmp_path):
    folder, proteins = str(tmp_path / "d"), scored.select("accession")
    drains.run(proteins, states(scored), folder, n_drains=2, shard=0, n_shards=2)
    with pytest.raises(ValueError, match="1"):
        drains.merged(spark, folder)
    drains.run(proteins, states(scored), folder, n_drains=2, shard=1, n_shards=2, most=1)
    with pytest.raises(ValueError):
        drains.merged(spark, folder)
    drains.run(proteins, states(scored), folder, n_drains=2, shard=1, n_shards=2)
    assert rows(drains.merged(spark, folder)) == rows(A.by_cluster(scored))
