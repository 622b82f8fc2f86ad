"""The entities of the analytics, as views over the star-schema and corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators.intervals import as_intervals
from helixframe.plans.staging import spread, table

#: Latent features of the bound encoder: one for each of the first vectors.
FEATURES = 16


def proteins(spark: SparkSession, at: str) -> DataFrame:
    docs = table(spark, at, "documents")
    return docs.select(F.col("doc_id").alias("accession"), F.col("text").alias("sequence"), F.col("n_chars").alias("length"), F.concat("lang", F.lit(":"), "source").alias("cluster_id"), "lang", "source")


def members(spark: SparkSession, at: str) -> DataFrame:
    """Orders as accessions, customers as clusters."""
    return table(spark, at, "orders").select(F.col("o_orderkey").alias("accession"), F.col("o_custkey").alias("cluster_id"))


def lengths(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "orders").select(F.col("o_orderkey").alias("accession"), (F.col("o_orderkey") % 40 + 30).cast("int").alias("length"))


def annotations(spark: SparkSession, at: str) -> DataFrame:
    rows = table(spark, at, "lineitem")
    return rows.select(
        F.col("l_orderkey").alias("accession"), F.concat("l_returnflag", "l_linestatus").alias("feature_type"), F.col("l_linenumber").cast("int").alias("start"),
        (F.col("l_linenumber") + F.col("l_quantity") - 1).cast("int").alias("end"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"),
    )


def enriched(spark: SparkSession, at: str) -> DataFrame:
    """Annotations with annot_subtype, the type and what the part is."""
    parts = table(spark, at, "part").select(F.col("p_partkey").alias("part"), F.col("p_type").alias("description"))
    return annotations(spark, at).join(parts, "part", "left").withColumn("annot_subtype", F.coalesce(F.concat("feature_type", F.lit(": "), "description"), "feature_type"))


def residues(spark: SparkSession, at: str) -> DataFrame:
    """Ten vectors to a protein, by id."""
    rows = spread(table(spark, at, "embeddings"))
    return rows.select(
        F.expr("vec_id div 10").alias("accession"), (F.col("vec_id") % 10 + 1).cast("int").alias("pos"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("annot_type")
    )


def residue_masks(spark: SparkSession, at: str) -> DataFrame:
    return residues(spark, at).select("accession", "annot_type", "pos")


def residue_intervals(spark: SparkSession, at: str) -> DataFrame:
    """The masks as intervals of a type apart from each other: accession, annot_type, a, b."""
    return as_intervals(residue_masks(spark, at), ["accession", "annot_type"])


def residue_lengths(spark: SparkSession, at: str) -> DataFrame:
    own = table(spark, at, "embeddings").groupBy(F.expr("vec_id div 10").alias("accession")).agg(F.count("*").cast("int").alias("length"))
    return own.withColumn("cluster_id", F.col("accession") % 7)


def weights(spark: SparkSession, at: str) -> DataFrame:
    rows = table(spark, at, "embeddings").filter(F.col("vec_id") < FEATURES)
    return rows.select(F.col("vec_id").alias("feature_id"), F.col("embedding").cast("array<double>").alias("w"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of sums doesn't show."""
    return df.select([F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


#: The same views in SQL, as common table expressions.
SQL = {
    "proteins": "proteins AS (SELECT doc_id AS accession, text AS sequence, n_chars AS length, lang || ':' || source AS cluster_id, lang, source FROM documents)",
    "members": "members AS (SELECT o_orderkey AS accession, o_custkey AS cluster_id FROM orders)",
    "lengths": "lengths AS (SELECT o_orderkey AS accession, o_orderkey % 40 + 30 AS length FROM orders)",
    "ann": """ann AS (SELECT l_orderkey AS accession, l_returnflag || l_linestatus AS feature_type, CAST(l_linenumber AS INT) AS start_,
        CAST(l_linenumber + l_quantity - 1 AS INT) AS end_, l_partkey AS part, l_suppkey AS supplier FROM lineitem)""",
    "enriched": "enriched AS (SELECT ann.*, p_type AS description, coalesce(feature_type || ': ' || p_type, feature_type) AS annot_subtype FROM ann LEFT JOIN part ON p_partkey = ann.part)",
    "res": "res AS (SELECT vec_id // 10 AS accession, CAST(vec_id % 10 + 1 AS INT) AS pos, CAST(embedding AS DOUBLE[]) AS x, label AS annot_type FROM embeddings)",
    "len": "len AS (SELECT accession, count(*) AS length, accession % 7 AS cluster_id FROM res GROUP BY accession)",
    "w": f"w AS (SELECT vec_id AS feature_id, CAST(embedding AS DOUBLE[]) AS w FROM embeddings WHERE vec_id < {FEATURES})",
    "dense": "dense AS (SELECT accession, pos, feature_id, annot_type, greatest(round(list_dot_product(x, w), 9), 0) AS z FROM res, w)",
    "act": "act AS (SELECT accession, pos, feature_id, annot_type, z FROM dense WHERE z > 0)",
    "conf": """npos AS (SELECT accession, annot_type, count(*) AS n_pos FROM res GROUP BY ALL),
        nact AS (SELECT accession, feature_id, count(*) AS n_active FROM act WHERE z > 0.1 GROUP BY ALL),
        hit AS (SELECT accession, feature_id, annot_type, count(*) AS tp FROM act WHERE z > 0.1 GROUP BY ALL),
        cnt AS (SELECT hit.*, n_active, n_pos, length, cluster_id, n_active - tp AS fp, n_pos - tp AS fn, length - n_pos - (n_active - tp) AS tn
            FROM hit JOIN npos USING (accession, annot_type) JOIN nact USING (accession, feature_id) JOIN len USING (accession)),
        conf AS (SELECT *, CASE WHEN fp * fn > 0 THEN tp * tn / CAST(fp * fn AS DOUBLE) WHEN tp > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END AS odds_ratio,
            (n_active * n_pos - tp) / nullif(CAST(length - 1 AS DOUBLE), 0) AS expected FROM cnt)""",
    "ap": """gate AS (SELECT *, tp / nullif(expected, 0) AS enrichment FROM conf WHERE odds_ratio >= 1.5),
        rk AS (SELECT g.accession, g.feature_id, g.annot_type, d.pos, d.z, CAST(d.annot_type = g.annot_type AS INT) AS y, g.n_pos
            FROM gate g JOIN dense d ON g.accession = d.accession AND g.feature_id = d.feature_id),
        pr AS (SELECT *, sum(y) OVER t / count(*) OVER t AS tie_precision, sum(y) OVER r / count(*) OVER r AS row_precision FROM rk
            WINDOW t AS (PARTITION BY accession, feature_id, annot_type ORDER BY z DESC RANGE UNBOUNDED PRECEDING),
                   r AS (PARTITION BY accession, feature_id, annot_type ORDER BY z DESC, pos ROWS UNBOUNDED PRECEDING)),
        ap AS (SELECT accession, feature_id, annot_type, sum(y * tie_precision) / max(n_pos) AS ap_ties, sum(y * row_precision) / max(n_pos) AS ap_rows FROM pr GROUP BY ALL)""",
    "fisher": """fisher AS (SELECT feature_id, annot_type, least(1, sum(exp(lgamma(a + b + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) + lgamma(c + d + 1) - lgamma(a + c - k + 1)
            - lgamma(d - a + k + 1) - lgamma(n + 1) + lgamma(a + c + 1) + lgamma(b + d + 1)))) AS p
        FROM (SELECT *, unnest(generate_series(CAST(a AS BIGINT), CAST(least(a + b, a + c) AS BIGINT))) AS k FROM cut WHERE NOT empty) GROUP BY ALL)""",
}
SQL["score"] = """rec AS (SELECT gate.*, ap_ties AS ap FROM gate JOIN ap USING (accession, feature_id, annot_type) WHERE ap_ties >= 0.05 AND {where}),
    per AS (SELECT feature_id, annot_type, cluster_id, avg(ap) AS ap, avg(enrichment) AS enrichment, avg(tp) AS tp, avg(fp) AS fp, avg(fn) AS fn, avg(tn) AS tn, count(*) AS n FROM rec GROUP BY ALL),
    agg AS (SELECT feature_id, annot_type, avg(ap) AS auprc_mean, median(ap) AS auprc_median, exp(avg(ln(CASE WHEN enrichment > 0 THEN enrichment END))) AS enrichment_gmean,
        sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn, CAST(sum(n) AS BIGINT) AS n_proteins, count(*) AS n_clusters FROM per GROUP BY ALL),
    cut0 AS (SELECT feature_id, annot_type, floor(round(tp, 6)) AS a, floor(round(fp, 6)) AS b, floor(round(fn, 6)) AS c, floor(round(tn, 6)) AS d FROM agg),
    cut AS (SELECT *, a + b + c + d AS n, (a + b = 0 OR c + d = 0 OR a + c = 0 OR b + d = 0) AS empty FROM cut0),
    {fisher},
    score AS (SELECT agg.*, CASE WHEN empty THEN NULL WHEN b * c > 0 THEN a * d / (b * c) ELSE CAST('inf' AS DOUBLE) END AS odds_ratio, coalesce(p, 1) AS fisher_p
        FROM agg JOIN cut USING (feature_id, annot_type) LEFT JOIN fisher USING (feature_id, annot_type))"""


def sql(*names: str, where: str = "true") -> str:
    """A WITH clause of the named views and what these need."""
    needs = {"enriched": ["ann"], "len": ["res"], "dense": ["res", "w"], "act": ["dense"], "conf": ["act", "len"], "ap": ["conf"], "score": ["ap"]}
    order: list[str] = []

    def add(name: str) -> None:
        for n in needs.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    parts = [SQL[n].format(where=where, fisher=SQL["fisher"]) if n == "score" else SQL[n] for n in order]
    return "WITH " + ",\n".join(parts)
