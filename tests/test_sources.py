"""Round trips of the readers and writers."""

import gzip

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

import __spark_entry__
from helixframe.sources import features, files, paged, providers


def test_tables(spark, tmp_path):
    (tmp_path / "t.tsv").write_text(" Entry \tSequence\tLENGTH\nP1\tACD\t3\nP2\t\n")
    df = files.read_tsv(spark, str(tmp_path / "t.tsv"), "a string, b string, c int")
    assert df.columns == ["a", "b", "c"]
    df = files.read_tsv(spark, str(tmp_path / "t.tsv"), columns=["entry"])
    assert df.columns == ["entry", "sequence", "length"] and [tuple(r) for r in df.collect()] == [("P1", "ACD", "3"), ("P2", None, None)]
    with pytest.raises(ValueError):
        files.read_tsv(spark, str(tmp_path / "t.tsv"), columns=["nope"])
    (tmp_path / "c.tsv").write_text("R1\tP1\nR1\tP2\n")
    assert [tuple(r) for r in files.read_clusters(spark, str(tmp_path / "c.tsv")).collect()] == [("R1", "P1"), ("R1", "P2")]
    files.write_tsv(df, str(tmp_path / "out"), single=True)
    assert files.read_tsv(spark, str(tmp_path / "out")).count() == 2


def test_fasta_marks_within_lines(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b"\n>sp|P1|A Exonuclease 5'->3' long\r\nMK\r\nLV\r\n>B >twice > x\nA>C\n>sp|P3|C\n\n>D\nGG")
    (tmp_path / "b.fa").write_text("; a comment\n>D again\nTT\n")
    got = {r["accession"]: r["sequence"] for r in files.read_fasta(spark, str(tmp_path)).collect()}
    assert got == {"P1": "MKLV", "B": "A>C", "P3": "", "D": "TT"}


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">sp|P12345|X_Y desc\nACD\nEF\n>Q2 more\nGG\n>Q2\nHH\n\n")
    got = {r["accession"]: r["sequence"] for r in files.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {"P12345": "ACDEF", "Q2": "HH"}
    df = spark.createDataFrame([("A", "MK"), ("B", ""), ("C", None), ("D", "WW")], "accession string, sequence string")
    files.write_fasta(df, str(tmp_path / "out"))
    assert {r["accession"]: r["sequence"] for r in files.read_fasta(spark, str(tmp_path / "out")).collect()} == {"A": "MK", "D": "WW"}


def test_gff(spark, tmp_path):
    (tmp_path / "a.gff").write_text("##gff\nP1\tdb\tHelix\t3\t9\t.\t.\t.\tID=1;Note=first;Note=kept\nP1\tdb\tTurn\t1\t2\t.\t.\t.\tID=2\nP1\tdb\tbad\n")
    assert [tuple(r) for r in files.read_gff(spark, str(tmp_path / "a.gff")).orderBy("start").collect()] == [("P1", "Turn", 1, 2, ""), ("P1", "Helix", 3, 9, "kept")]


def parse(spark, field, value):
    df = spark.createDataFrame([("P", value)], ["accession", field])
    return [(r["start"], r["end"], r["description"], r["annot_subtype"]) for r in features.parsed(features.long_form(df)).orderBy("start").collect()]


def test_feature_strings(spark):
    value = 'BINDING 10..20; /ligand="ATP"; BINDING 50; /ligand="Mg(2+)"; /note="catalytic"'
    assert parse(spark, "ft_binding", value) == [(10, 20, "ATP", "Binding site: ATP"), (50, 50, "Mg(2+); catalytic", "Binding site: Mg(2+); catalytic")]
    assert parse(spark, "Mutagenesis", 'MUTAGEN 5; /note="E->A: Lack of activity"') == [(5, 5, "", "Mutagenesis")]
    for name in ("Motif [FT]", "Repeat", "Natural variant [FT]", "Sequence conflict"):
        assert len(parse(spark, name, "X 5")) == 1
    assert parse(spark, "ft_chain", "CHAIN 1..9") == []
    assert parse(spark, "ft_site", "-") == parse(spark, "ft_site", "SITE <1; /note=\"x\"") == parse(spark, "ft_site", "SITE 9..3") == []
    assert parse(spark, "ft_site", 'SITE 1; /note="By similarity; Cleavage [ECO:0001]"') == [(1, 1, "Cleavage", "Site: Cleavage")]
    assert parse(spark, "ft_site", f'SITE 1; /note="{"x" * 200}"')[0][2] == "x" * 120


def test_feature_strings_are_parsed_once(spark):
    """A pattern for the place and one for each of three marks, none worked out again by filters; an empty mark is not a missing one."""
    df = spark.createDataFrame([("p", 'SITE 1; /note=""; /description="d"; SITE 2..3; /description="e"; SITE 4; /note="open')], "accession string, ft_site string")
    rows = features.parsed(features.long_form(df))
    assert [(r["start"], r["end"], r["description"]) for r in rows.orderBy("start").collect()] == [(1, 1, ""), (2, 3, "e"), (4, 4, "")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 4


def test_shards_rejects_and_metadata(spark, tmp_path):
    df = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, "train").otherwise("val").alias("split"))
    files.write_shards(df.coalesce(1), str(tmp_path / "s"), rows=100)
    assert len(list((tmp_path / "s" / "split=train").glob("*.parquet"))) == 5
    assert files.read_parts(spark, str(tmp_path / "s")).count() == 1000
    tagged = df.withColumn("skip_reason", F.when(F.col("id") < 10, "small"))
    files.write_with_rejects(tagged, str(tmp_path / "ok"), str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 990 and spark.read.parquet(str(tmp_path / "bad")).count() == 10
    files.write_metadata(spark, {"n": 3, "name": "x"}, str(tmp_path / "m"))
    assert files.read_metadata(spark, str(tmp_path / "m"), "n long, name string").first()["n"] == 3
    assert files.write_once(df, str(tmp_path / "o")).count() == 1000 and files.write_once(df.limit(1), str(tmp_path / "o")).count() == 1000
    assert files.read_first(spark, [str(tmp_path / "none"), str(tmp_path / "o")], "id long, split string").count() == 1000
    assert files.read_first(spark, [str(tmp_path / "none")], "id long").columns == ["id"]
    files.append_log(df.limit(2), str(tmp_path / "l"))
    files.append_log(df.limit(3), str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).count() == 5
    files.write_report(spark.createDataFrame([(2, "b"), (1, "a")], "no int, line string"), str(tmp_path / "r"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "r")).collect()] == ["a", "b"]


PAGES = {
    "u1": (b"h\na\n", '<u2>; rel="next"'), "u2": (gzip.compress(b"h\nb\nc\n"), ""), "v1": (b"h\nz\n", ""),
}


def fetch(url):
    return PAGES[url]


def test_pages(spark):
    assert list(paged.lines("u1", fetch)) == ["h", "a", "b", "c"]
    got = {(r["url"], r["line"]) for r in paged.read_paged(spark, ["u1", "v1"], PAGES.__getitem__).collect()}
    assert got == {("u1", "h"), ("u1", "a"), ("u1", "b"), ("u1", "c"), ("v1", "h"), ("v1", "z")}


def test_stream_of_pages_goes_on(spark, tmp_path):
    """Several cursors, a page that fails, one cursor that ends before the other: each line once."""
    for i, (body, more) in enumerate([("h\na\nb\n", "u1"), ("h\nc\n", "u2"), ("h\n\nd\ne", ""), ("h\nz\n", "")]):
        (tmp_path / f"u{i}").write_text(f"{more}|{body}")
    folder = str(tmp_path)

    def served(broken):
        def get(url):
            if url in broken:
                raise ConnectionError(url)
            with open(f"{folder}/{url}", encoding="utf-8") as file:
                more, body = file.read().split("|", 1)
            return body.encode(), f'<{more}>; rel="next"' if more else ""

        return get

    for broken in (["u2"], ["u2"], [], []):
        try:
            paged.stream_to(spark, ["u0", "u3"], f"{folder}/out", f"{folder}/state", served(broken))
            assert not broken
        except StreamingQueryException:
            assert broken
    got = sorted((r["url"], r["no"], r["line"]) for r in spark.read.parquet(f"{folder}/out").collect())
    assert got == [("u0", i, c) for i, c in enumerate("habcde")] + [("u3", 0, "h"), ("u3", 1, "z")]
    stream = paged._Stream(["u0", "u3"], served([]))
    begin = stream.initialOffset()
    rows, end = [], begin
    for _ in range(4):
        own, end = stream.read(end)
        rows += list(own)
    assert sorted(stream.readBetweenOffsets(begin, end)) == sorted(rows) == got and stream.read(end)[1] == end


def test_attention_by_heads(spark):
    def make():
        def provider(texts):
            return [np.ones((2, 3, len(t), len(t) + ("X" in t))) / len(t) for t in texts]

        return provider

    df = spark.createDataFrame([(1, "ABCD"), (2, "AXC"), (3, ""), (4, None), (5, "AB" * 400)], "accession long, sequence string")
    rows = providers.attended(df, make, batch=2).cache()
    assert [(r["accession"], r["query"], r["error"][:13]) for r in rows.filter("error IS NOT NULL").collect()] == [(2, None, "ValueError: 2")]
    assert {r["accession"]: r["n"] for r in rows.filter("error IS NULL").groupBy("accession").agg(F.count("*").alias("n")).collect()} == {1: 2 * 3 * 4, 5: 2 * 3 * 800}
    keys = providers.by_key(rows.filter("accession = 1"))
    got = {tuple(r)[:5]: r["weight"] for r in keys.collect()}
    assert got == {(1, lay, h, q, k): 0.25 for lay in (1, 2) for h in (1, 2, 3) for q in (1, 2, 3, 4) for k in (1, 2, 3, 4)}


def test_short_table_is_dealt_to_all_cores(spark, tmp_path):
    """A table of one file is more than one task's work; answers of several widths, errors and batches keep their rows."""
    spark.range(40).selectExpr("id AS p_partkey", "concat('TYPE ', id) AS p_type").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    df = __spark_entry__.queries()["provided_vectors"](spark, str(tmp_path))
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert {(r["accession"], r["pos"], r["code"], r["length"]) for r in df.collect()} == {(i, n, float(ord(c)), float(len(t))) for i in range(40) for t in [f"TYPE {i}"] for n, c in enumerate(t, 1)}


def test_vectors_of_several_widths(spark):
    def make():
        def provider(texts):
            if "X" in texts[0]:
                raise ValueError("x")
            return [np.full((len(t), len(t)), float("nan") if t == "N" else len(t)) for t in texts]

        return provider

    df = spark.createDataFrame([(None, "AB"), ("p", "X"), ("q", "ABC"), ("r", "")], "accession string, sequence string").coalesce(1)
    rows = providers.provided(df, make, batch=1)
    assert rows.dtypes == [("accession", "string"), ("pos", "int"), ("x", "array<double>"), ("error", "string")]
    assert [tuple(r) for r in rows.collect()] == [(None, 1, [2.0, 2.0], None), (None, 2, [2.0, 2.0], None), ("p", None, None, "ValueError: x"), *[("q", i, [3.0] * 3, None) for i in (1, 2, 3)]]
