"""NumPy archives against NumPy itself."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.sources import archives


def arrays(df):
    out = {}
    for r in df.orderBy("name", "row").collect():
        out.setdefault(r["name"], []).append(r["whole"] if r["value"] is None else r["value"])
    return {k: np.array(v) for k, v in out.items()}


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_read(spark, tmp_path, save):
    rng = np.random.default_rng(1)
    given = {
        "x": rng.normal(size=(1000, 7)).astype("float32"), "ids": rng.integers(-(2**62), 2**62, 501), "cube": rng.normal(size=(5, 3, 2)), "columns": np.asfortranarray(rng.normal(size=(6, 4))),
        "n_seen": np.array(17), "on": rng.random(9) > 0.5, "none": np.zeros((0, 3)), "big": np.arange(4, dtype=">i4"),
    }
    save(tmp_path / "a.npz", **given)
    df = archives.read_npz(spark, str(tmp_path / "a.npz"), part_bytes=1000)
    got = arrays(df)
    assert set(got) == set(given) - {"none"}
    for name, x in got.items():
        assert np.array_equal(x, np.atleast_1d(given[name]).reshape(len(x), -1)), name
    assert (df.rdd.getNumPartitions() > 30) == (save is np.savez)  # an array over many tasks
    assert {r["dtype"] for r in df.filter("name = 'x'").collect()} == {"<f4"}
    assert set(arrays(archives.read_npz(spark, str(tmp_path / "a.npz"), ["ids", "on"]))) == {"ids", "on"}


def test_objects_are_refused(spark, tmp_path):
    np.savez(tmp_path / "o.npz", o=np.array([{}], object))
    with pytest.raises(Exception, match="objects"):
        archives.read_npz(spark, str(tmp_path / "o.npz")).collect()


def test_round_trip(spark, tmp_path):
    """Two dtypes, an array over several tasks; other readers load the parts."""
    path = str(tmp_path / "out")
    rows = spark.range(3000).select(F.lit("x").alias("name"), F.col("id").alias("row"), F.array(F.col("id") / 3, F.sqrt("id")).alias("value"), F.lit(None).cast("array<long>").alias("whole"))
    rows = rows.unionByName(spark.range(40).select(F.lit("n").alias("name"), F.col("id").alias("row"), F.lit(None).cast("array<double>").alias("value"), F.array(F.col("id") * 2**55).alias("whole"))).repartition(7)
    archives.write_npz(rows, path, dtype="float32", tasks=4)
    parts = [f for f in os.listdir(path) if f.endswith(".npz")]
    assert len(parts) > 1 and os.path.exists(f"{path}/_SUCCESS") and not any(f.startswith(".") for f in parts)
    got = arrays(archives.read_npz(spark, path))
    i = np.arange(3000)
    assert np.array_equal(got["x"], np.stack([i / 3, np.sqrt(i)], 1).astype("float32")) and np.array_equal(got["n"][:, 0], np.arange(40) * 2**55)
    assert sum(len(np.load(f"{path}/{f}")["x"]) for f in parts if "x" in np.load(f"{path}/{f}")) == 3000
    archives.write_npz(rows.filter("name = 'n'"), path)  # over what was there
    assert set(arrays(archives.read_npz(spark, path))) == {"n"}
    assert archives.npz_once(rows, path).select("name").distinct().count() == 1  # what was committed stays


def test_failed_jobs_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    gap = spark.createDataFrame([("x", 0, [1.0]), ("x", 2, [2.0])], "name string, row long, value array<double>").coalesce(1)
    with pytest.raises(Exception, match="does not follow"):
        archives.write_npz(gap, path)
    assert not os.path.exists(f"{path}/_SUCCESS") and archives.read_npz(spark, path).count() == 0
