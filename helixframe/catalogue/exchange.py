"""Queries through the readers, writers and providers: whole tables written and read back."""

from __future__ import annotations

import contextlib
import glob
import gzip
import uuid

import numpy as np
from pyspark.errors import StreamingQueryException
from pyspark.sql import Window
from pyspark.sql import functions as F

from helixframe.catalogue import reports as R
from helixframe.catalogue import selection as S
from helixframe.operators import attention, autoencoder, prep
from helixframe.plans import bindings as B
from helixframe.plans.bindings import rounded, sql
from helixframe.plans.staging import checkpoint_dir, spread, table
from helixframe.sources import archives, files, paged, providers

#: Types that the bound provider fails on.
UNKNOWN = "STANDARD"


def _folder(spark):
    return f"{checkpoint_dir(spark)}/exchange-{uuid.uuid4().hex}"


def tsv_round_trip(spark, at):
    path = _folder(spark)
    files.write_tsv(B.annotations(spark, at).select("accession", "feature_type", "start", "end"), path)
    return files.read_tsv(spark, path, "accession long, feature_type string, start int, end int", ["accession", "end"])


def indexed_csv_round_trip(spark, at):
    """Counts by group, the group as the first column of one file."""
    path = _folder(spark)
    files.write_tsv(B.annotations(spark, at).groupBy("feature_type").agg(F.count("*").alias("n")), path, single=True)
    return files.read_tsv(spark, path, "feature_type string, n long")


def headerless_clusters(spark, at):
    path = _folder(spark)
    B.members(spark, at).select(F.concat_ws("\t", "cluster_id", "accession").alias("value")).write.text(path)
    return files.read_clusters(spark, path)


def fasta_round_trip(spark, at):
    path = _folder(spark)
    letters = F.upper(F.regexp_replace("sequence", "[^A-Za-z]", ""))
    files.write_fasta(B.proteins(spark, at).select("accession", letters.alias("sequence")), path)
    return files.read_fasta(spark, path).select(F.col("accession").cast("long").alias("accession"), F.md5("sequence").alias("md5"), F.length("sequence").alias("length"))


def fasta_described(spark, at):
    """Records as databases write them: bars, marks of records within the line, and lines of ten letters."""
    path = _folder(spark)
    letters = F.upper(F.regexp_replace("p_type", "[^A-Za-z]", ""))
    header = F.concat(F.lit(">sp|P"), F.col("p_partkey").cast("string"), F.lit("|"), F.regexp_replace("p_brand", "\\s", "_"), F.lit(" "), F.col("p_type"), F.lit(" 5'->3' exonuclease >fragment"))
    table(spark, at, "part").select(F.concat(header, F.lit("\r\n"), F.regexp_replace(letters, "(.{10})", "$1\n")).alias("value")).write.text(path)
    return files.read_fasta(spark, path)


def npz_round_trip(spark, at):
    """Vectors and labels as arrays of archives."""
    path, rows = _folder(spark), table(spark, at, "embeddings")
    vectors = rows.select(F.lit("vectors").alias("name"), F.col("vec_id").alias("row"), F.col("embedding").cast("array<double>").alias("value"), F.lit(None).cast("array<long>").alias("whole"))
    labels = rows.select(F.lit("labels").alias("name"), F.col("vec_id").alias("row"), F.lit(None).cast("array<double>").alias("value"), F.array(F.col("label").cast("long")).alias("whole"))
    archives.write_npz(vectors.unionByName(labels), path, dtype="float32")
    found = archives.read_npz(spark, path, part_bytes=4096)
    own = found.filter("name = 'vectors'").select(F.col("row").alias("vec_id"), "dtype", F.size("value").alias("n"), F.get("value", F.lit(0)).alias("first"), F.element_at("value", -1).alias("last"))
    return rounded(own.join(found.filter("name = 'labels'").select(F.col("row").alias("vec_id"), F.get("whole", F.lit(0)).alias("label")), "vec_id"))


def saved_model(spark, at):
    """The bound encoder as a model, saved after two epochs and loaded again."""
    folder, rows = _folder(spark), B.weights(spark, at).orderBy("feature_id").collect()  # one model
    w = np.array([r["w"] for r in rows])
    model = autoencoder.Model(autoencoder.Config(latents=len(w)), 2 * w, np.arange(float(len(w))), w, np.zeros(w.shape[1]), ever=np.arange(len(w)) % 2 == 0)
    for epoch in (0, 1):
        autoencoder.save(spark, model, folder, epoch)
        model.w_enc = w
    found = autoencoder.load(spark, folder)
    ever = spark.createDataFrame([(k, bool(e)) for k, e in enumerate(found.ever)], "feature_id long, ever boolean")
    return rounded(autoencoder.weight_table(spark, found).join(ever, "feature_id").select("feature_id", F.get("w", F.lit(0)).alias("first"), F.element_at("w_dec", -1).alias("last"), "b", "ever"))


def default_column(spark, at):
    """A column that one table has and another lacks."""
    regions = prep.with_default(table(spark, at, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key")), "kind", "region")
    nations = table(spark, at, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"), F.lit("nation").alias("kind"))
    return regions.unionByName(prep.with_default(nations, "kind", "region"))


def metadata_round_trip(spark, at):
    path = _folder(spark)
    values = B.proteins(spark, at).agg(F.count("*").alias("n"), F.max("length").alias("longest"), F.count_distinct("lang").alias("langs")).first().asDict()
    files.write_metadata(spark, values | {"table": "documents"}, path)
    return files.read_metadata(spark, path, "n long, longest long, langs long, table string")


def kept_once(spark, at):
    """A cache: what was written first stays."""
    path, rows = _folder(spark), B.members(spark, at)
    files.write_once(rows, path)
    return files.write_once(rows.withColumn("cluster_id", F.lit(0)), path).select("accession", "cluster_id")


def shards_round_trip(spark, at):
    path = _folder(spark)
    files.write_shards(B.proteins(spark, at).select("accession", "length", "lang"), path, by="lang")
    shard = Window.partitionBy("_metadata.file_path")
    return files.read_parts(spark, path).select("accession", "length", (F.count("*").over(shard) <= 512).alias("fits"))


def first_found(spark, at):
    return files.read_first(spark, [f"{_folder(spark)}/none", f"{at}/nation.parquet"], "n_nationkey int, n_name string, n_regionkey int")


def report_lines(spark, at):
    """Types in the order of their counts, a line for each."""
    path = _folder(spark)
    counts = B.annotations(spark, at).groupBy("feature_type").agg(F.count("*").alias("n")).withColumn("no", F.row_number().over(Window.orderBy(F.desc("n"), "feature_type")))
    files.write_report(counts.select("no", F.concat_ws(" ", "no", "feature_type", "n").alias("line")), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def appended_log(spark, at):
    """A row for each region, written one after the other."""
    path, nations = _folder(spark), table(spark, at, "nation")
    for region in range(table(spark, at, "region").agg(F.max("r_regionkey") + 1).first()[0] or 0):
        files.append_log(nations.filter(F.col("n_regionkey") == region).agg(F.lit(region).alias("epoch"), F.count("*").alias("n")), path)
    return spark.read.parquet(path)


def paged_rows(spark, at):
    """The nations, of whom there are 25, as a service of five to a page, every second page compressed."""
    nations = [f"{r['n_nationkey']}\t{r['n_name']}" for r in table(spark, at, "nation").orderBy("n_nationkey").collect()]
    answers = {}
    for p in range(0, len(nations), 5):
        body = "\n".join(["key\tname", *nations[p : p + 5]]).encode()
        more = f'<page{p + 5}>; rel="next"' if p + 5 < len(nations) else ""
        answers[f"page{p}"] = (gzip.compress(body) if p % 2 else body, more)
    rows = paged.read_paged(spark, ["page0"], answers.__getitem__).filter("no > 0")
    return rows.select("no", F.split("line", "\t")[0].cast("int").alias("n_nationkey"), F.split("line", "\t")[1].alias("n_name"))


def _page_files(spark, at, folder):
    """The nations as pages of five, a file each with the next page's name; written by Spark."""
    numbered = table(spark, at, "nation").withColumn("page", F.floor((F.row_number().over(Window.orderBy("n_nationkey")) - 1) / 5))  # a table of 25 rows
    lines = numbered.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda r: F.concat_ws("\t", r["n_nationkey"].cast("string"), r["n_name"])), "\n").alias("body"))
    more = F.coalesce(F.lead("page").over(Window.orderBy("page")).cast("string"), F.lit(""))
    lines.select("page", F.concat(more, F.lit("\nkey\tname\n"), "body").alias("value")).write.partitionBy("page").text(folder)


def paged_stream(spark, at):
    """The same pages as a stream that fails after the second page and is started again."""
    folder = _folder(spark)
    _page_files(spark, at, f"{folder}/pages")

    local = f"{folder}/pages".removeprefix("file:")

    def served(most=None):
        def get(url):
            number = int(url.removeprefix("page"))
            if most is not None and number >= most:
                raise ConnectionError(url)
            (path,) = glob.glob(f"{local}/page={number}/part-*")
            with open(path, encoding="utf-8") as file:
                more, body = file.read().split("\n", 1)
            return body.encode(), f'<page{more}>; rel="next"' if more else ""

        return get

    with contextlib.suppress(StreamingQueryException):
        paged.stream_to(spark, ["page0"], f"{folder}/rows", f"{folder}/state", served(2))
    paged.stream_to(spark, ["page0"], f"{folder}/rows", f"{folder}/state", served())
    rows = spark.read.parquet(f"{folder}/rows").filter("no > 0")
    return rows.select("no", F.split("line", "\t")[0].cast("int").alias("n_nationkey"), F.split("line", "\t")[1].alias("n_name"))


def _letters():
    def provider(texts):
        if any(t.startswith(UNKNOWN) for t in texts):
            raise ValueError("not known")
        codes = [np.frombuffer(t.encode("utf-32-le"), "<u4") for t in texts]
        return [np.stack([c, np.full_like(c, len(c))], axis=1) for c in codes]

    return provider


def provided_vectors(spark, at):
    """A model of two numbers for each letter, that fails on some sequences, of which each gives a row."""
    parts = spread(table(spark, at, "part").select(F.col("p_partkey").alias("accession"), F.col("p_type").alias("sequence")))
    rows = providers.provided(parts, _letters)
    return rows.select("accession", "pos", F.get("x", F.lit(0)).alias("code"), F.get("x", F.lit(1)).alias("length"), "error")


def _near():
    def provider(texts):
        apart = lambda n: np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
        return [np.array([[1 / (layer * (head + apart(len(t)))) for head in (1, 2)] for layer in (1, 2)]) for t in texts]

    return provider


def provided_attention(spark, at):
    """Profiles from a model whose weights fall with the distance."""
    nations = table(spark, at, "nation").select(F.col("n_nationkey").alias("accession"), F.col("n_name").alias("sequence"))
    return rounded(attention.profiles(providers.by_key(providers.attended(nations, _near))))


def spread_types(spark, at):
    """Types whose peak layers lie apart, in order."""
    chosen = attention.spread_peaks(S.layer_rows(spark, at).withColumnRenamed("auprc_mean", "auprc"), 3, 1)
    return spark.createDataFrame(list(enumerate(chosen, 1)), "nth int, annot_type int")


QUERIES = {f.__name__: f for f in (
    tsv_round_trip, indexed_csv_round_trip, headerless_clusters, fasta_round_trip, fasta_described, npz_round_trip, saved_model, default_column, metadata_round_trip, kept_once, shards_round_trip, first_found, report_lines, appended_log, paged_rows, paged_stream,
    provided_vectors, provided_attention, spread_types,
)}

_NEAR = """atn AS (SELECT n_nationkey AS accession, layer, head, query, key, 1 / CAST(layer * (head + abs(query - key)) AS DOUBLE) AS weight
        FROM (SELECT *, unnest(generate_series(1, length(n_name))) AS query FROM nation) n, LATERAL (SELECT unnest(generate_series(1, length(n.n_name))) AS key), (VALUES (1), (2)) l(layer), (VALUES (1), (2)) h(head)),
    sent AS"""

ORACLE_SQL = {
    "tsv_round_trip": f'{sql("ann")} SELECT accession, feature_type, start_ AS "start", end_ AS "end" FROM ann',
    "indexed_csv_round_trip": f"{sql('ann')} SELECT feature_type, count(*) AS n FROM ann GROUP BY 1",
    "headerless_clusters": f"{sql('members')} SELECT CAST(cluster_id AS VARCHAR) AS cluster_id, CAST(accession AS VARCHAR) AS accession FROM members",
    "fasta_round_trip": f"""{sql("proteins")}, s AS (SELECT accession, upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) AS sequence FROM proteins)
        SELECT accession, md5(sequence) AS md5, CAST(length(sequence) AS INT) AS length FROM s WHERE length(sequence) > 0""",
    "fasta_described": "SELECT 'P' || p_partkey AS accession, upper(regexp_replace(p_type, '[^A-Za-z]', '', 'g')) AS sequence FROM part",
    "npz_round_trip": "SELECT vec_id, '<f4' AS dtype, len(embedding) AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[-1] AS DOUBLE), 6) AS last, CAST(label AS BIGINT) AS label FROM embeddings",
    "saved_model": f"{sql('w')} SELECT feature_id, round(w[1], 6) AS first, round(w[-1], 6) AS last, CAST(feature_id AS DOUBLE) AS b, feature_id % 2 = 0 AS ever FROM w",
    "default_column": "SELECT r_name AS name, r_regionkey AS key, 'region' AS kind FROM region UNION ALL SELECT n_name, n_nationkey, 'nation' FROM nation",
    "metadata_round_trip": f"{sql('proteins')} SELECT count(*) AS n, max(length) AS longest, count(DISTINCT lang) AS langs, 'documents' AS \"table\" FROM proteins",
    "kept_once": f"{sql('members')} SELECT accession, cluster_id FROM members",
    "shards_round_trip": f"{sql('proteins')} SELECT accession, length, true AS fits FROM proteins",
    "first_found": "SELECT * FROM nation",
    "report_lines": f"{sql('ann')}, c AS (SELECT feature_type, count(*) AS n FROM ann GROUP BY 1) SELECT row_number() OVER (ORDER BY n DESC, feature_type) || ' ' || feature_type || ' ' || n AS line FROM c",
    "appended_log": "SELECT r_regionkey AS epoch, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1",
    "paged_rows": "SELECT row_number() OVER (ORDER BY n_nationkey) AS no, n_nationkey, n_name FROM nation",
    "provided_vectors": f"""SELECT p_partkey AS accession, CAST(pos AS INT) AS pos, CAST(ascii(substr(p_type, pos, 1)) AS DOUBLE) AS code, CAST(length(p_type) AS DOUBLE) AS length, CAST(NULL AS VARCHAR) AS error
        FROM (SELECT *, unnest(generate_series(1, length(p_type))) AS pos FROM part WHERE NOT starts_with(p_type, '{UNKNOWN}'))
        UNION ALL SELECT p_partkey, NULL, NULL, NULL, 'ValueError: not known' FROM part WHERE starts_with(p_type, '{UNKNOWN}')""",
    "provided_attention": f"WITH {_NEAR}{R.ATTENTION.split('sent AS', 1)[1].split('prof9 AS')[0].rstrip().rstrip(',')} SELECT accession, pos, attn_agg, round(score, 6) AS score FROM prof",
    "spread_types": f"""{S.LAYERS.replace('WITH', 'WITH RECURSIVE', 1)}, pk AS (SELECT * FROM lr QUALIFY row_number() OVER (PARTITION BY annot_type ORDER BY auprc_mean DESC, layer) = 1),
        od AS (SELECT *, row_number() OVER (ORDER BY auprc_mean DESC, annot_type) AS r FROM pk),
        go AS (SELECT CAST(0 AS BIGINT) AS r, CAST([] AS INT[]) AS taken, CAST(NULL AS BIGINT) AS annot_type, false AS chosen
            UNION ALL SELECT r, CASE WHEN ok THEN list_append(taken, layer) ELSE taken END, annot_type, ok
            FROM (SELECT od.r, taken, od.layer, od.annot_type, len(taken) < 3 AND len(list_filter(taken, lambda t: abs(t - od.layer) < 1)) = 0 AS ok FROM go JOIN od ON od.r = go.r + 1))
        SELECT CAST(row_number() OVER (ORDER BY chosen DESC, r) AS INT) AS nth, CAST(annot_type AS INT) AS annot_type FROM go WHERE annot_type IS NOT NULL ORDER BY nth LIMIT 3""",
}
ORACLE_SQL["paged_stream"] = ORACLE_SQL["paged_rows"]
