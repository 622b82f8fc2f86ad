"""Queries behind figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.catalogue import alignment as Q
from helixframe.catalogue import reports as R
from helixframe.functions.scales import FIGURES, scale_table
from helixframe.operators import evidence, figures
from helixframe.operators.prep import RESIDUES
from helixframe.plans import bindings as B
from helixframe.plans.bindings import rounded, sql

TYPES = [0, 1, 2, 3]


def heat_matrix(spark, at):
    out = figures.heat_matrix(Q._scores(spark, at), "feature_id", "annot_type", "auprc_mean", TYPES)
    return rounded(out.toDF("feature_id", *[f"t{t}" for t in TYPES]))


def last_matrix(spark, at):
    out = figures.last_matrix(rounded(Q._scores(spark, at)), "annot_type", "n_clusters", "auprc_mean", "feature_id", [5, 6, 7])
    return rounded(out.toDF("annot_type", "c5", "c6", "c7"))


def heat_column_order(spark, at):
    return rounded(figures.column_order(rounded(Q._scores(spark, at)), "feature_id", "annot_type", "auprc_mean"))


def unique_in_order(spark, at):
    scores = rounded(Q._scores(spark, at))
    best = lambda t: scores.filter(F.col("annot_type") == t).select("feature_id", (-F.col("auprc_mean")).alias("rank"))
    return figures.unique_in_order([best(3), best(1)], "feature_id", "rank", 12)


def normalized_evidence(spark, at):
    rows = R.structural_alignment(spark, at).filter("annot_type = 3").join(R.cohen_d(spark, at).select("feature_id", "cohen_d"), "feature_id")
    return rounded(figures.without_empty_metrics(figures.normalized_evidence(rows.withColumn("none", F.lit(0.0))), ["cosine", "cohen_d", "none"]), 7)


def best_accession(spark, at):
    return evidence.best_contrasts(*R._evidence(spark, at), B.weights(spark, at)).select("feature_id", "accession", "contrast")


def property_effects(spark, at):
    return rounded(figures.property_effects(R._lettered(spark, at), scale_table(spark, FIGURES)))


QUERIES = {f.__name__: f for f in (heat_matrix, last_matrix, heat_column_order, unique_in_order, normalized_evidence, best_accession, property_effects)}

_SCALES = ", ".join(f"('{r}', '{p}', {float(v)}::DOUBLE)" for p, values in FIGURES.items() for r, v in zip(RESIDUES, values, strict=True))
_S = f"{sql('score')}, {Q.ROUNDED}"
ORACLE_SQL = {
    "heat_matrix": f"""{sql('score')} SELECT feature_id, {', '.join(f"round(coalesce(avg(auprc_mean) FILTER (annot_type = {t}), 0), 6) AS t{t}" for t in TYPES)} FROM score GROUP BY 1""",
    "last_matrix": f"""{_S} SELECT annot_type, {', '.join(f"coalesce(arg_max(auprc_mean, feature_id) FILTER (n_clusters = {c}), 0) AS c{c}" for c in (5, 6, 7))} FROM s GROUP BY 1""",
    "heat_column_order": f"""{_S}, p AS (SELECT annot_type, feature_id AS peak, auprc_mean AS peak_value FROM s QUALIFY row_number() OVER (PARTITION BY annot_type ORDER BY auprc_mean DESC, feature_id) = 1)
        SELECT *, row_number() OVER (ORDER BY peak, peak_value DESC, annot_type) AS place FROM p""",
    "unique_in_order": f"""{_S}, u AS (SELECT feature_id, CASE annot_type WHEN 3 THEN 0 ELSE 1 END AS l, -auprc_mean AS r FROM s WHERE annot_type IN (3, 1)),
        f AS (SELECT feature_id, min(struct_pack(l := l, r := r)) AS at_ FROM u GROUP BY 1) SELECT feature_id AS key FROM f ORDER BY at_, feature_id LIMIT 12""",
    "normalized_evidence": f"""SELECT feature_id, annot_type, round((cosine + 1) / 2, 7) AS cosine, round(least(abs(cohen_d), 2) / 2, 7) AS cohen_d
        FROM ({R.ORACLE_SQL['structural_alignment']}) JOIN ({R.ORACLE_SQL['cohen_d']}) USING (feature_id) WHERE annot_type = 3""",
    "best_accession": f"""{sql('dense')}, p AS (SELECT accession, feature_id, round(coalesce(avg(z) FILTER (annot_type = 3), 0) - coalesce(avg(z) FILTER (annot_type <> 3), 0), 6) AS contrast, count(*) FILTER (annot_type = 3) AS n
            FROM dense GROUP BY ALL HAVING n > 0)
        SELECT feature_id, accession, contrast FROM p QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY contrast DESC, accession) = 1""",
    "property_effects": f"""{sql('proteins')}, p AS (SELECT upper(regexp_replace(sequence, '[^ -~]', '', 'g')) AS s FROM proteins),
        c AS (SELECT unnest(string_split(s, '')) AS residue, unnest(generate_series(1, length(s))) AS pos FROM p WHERE s <> ''), scale(residue, property, value) AS (VALUES {_SCALES}),
        v AS (SELECT property, pos % 5 = 0 AS inside, value FROM c JOIN scale USING (residue)),
        m AS (SELECT property, min(value) AS low, max(value) AS high FROM v GROUP BY 1),
        n AS (SELECT property, inside, (value - low) / (high - low) AS v FROM v JOIN m USING (property)),
        g AS (SELECT property, avg(v) FILTER (inside) AS mi, avg(v) FILTER (NOT inside) AS mo, var_pop(v) FILTER (inside) AS vi, var_pop(v) FILTER (NOT inside) AS vo FROM n GROUP BY 1)
        SELECT property, round(mi, 6) AS mean_in, round(mo, 6) AS mean_out, round((mi - mo) / sqrt((vi + vo) / 2), 6) AS effect FROM g""",
}
