"""Every query against its SQL twin, and the stream's statistics over repeated runs."""

import math
import shutil

import duckdb
import pytest

import __spark_entry__ as entry
from helixframe.streaming import running

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 5) + 0.0 if isinstance(v, float) else str(v)
    return sorted(repr([value(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="session")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, tiny, name):
    df = QUERIES[name](spark, tiny)
    out = duck.execute(SQL[name])
    names = [c[0] for c in out.description]
    assert sorted(df.columns) == sorted(names)
    assert normal(df.columns, df.collect()) == normal(names, out.fetchall())


def test_letters_without_one_upper_case_match_sql(spark, tmp_path):
    """ß, ligatures and others that become several letters are left out; ı and ſ count as I and S."""
    texts = ["Schß erie", "ß", "ﬁn ﬀ ﬆ ﬄ", "ŉ ǰ ẖẗẘẙẚ", "dıeſ", None, "", "a1b ß"]
    rows = [(i, t, "de", "web", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df, out = QUERIES["union_skip_reasons"](spark, str(tmp_path)), con.execute(SQL["union_skip_reasons"])
    names = [c[0] for c in out.description]
    assert normal(df.columns, df.collect()) == normal(names, out.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, tiny, name):
    assert QUERIES[name](spark, tiny).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_stream_takes_each_file_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1, "a", 1.0), (2, "a", 3.0), (3, "b", 0.0)]
    schema = "event_id long, event_type string, value double"
    spark.createDataFrame(rows, schema).write.parquet(source)
    running.available_now(spark, source, target, schema)
    spark.createDataFrame([(4, "b", 4.0)], schema).write.mode("append").parquet(source)
    running.available_now(spark, source, target, schema)
    running.available_now(spark, source, target, schema)
    got = {r["event_type"]: (r["n"], r["mean"], r["max"]) for r in spark.read.parquet(target).collect()}
    assert got == {"a": (2, 2.0, 3.0), "b": (2, 2.0, 4.0)}
    shutil.rmtree(tmp_path)
