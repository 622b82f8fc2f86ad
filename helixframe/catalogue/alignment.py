"""Queries over latent activations and their alignment with annotations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from helixframe.operators import alignment as A
from helixframe.operators import drains
from helixframe.operators import encoding as E
from helixframe.plans import bindings as B
from helixframe.plans.bindings import rounded, sql
from helixframe.plans.staging import checkpoint_dir

#: Thresholds that fit tables of a few hundred proteins; the operators' own defaults are for real ones.
LEAST_PROTEINS, LEAST_CLUSTERS, MOST_P = 3, 3, 0.5


def _active(spark, at):
    return E.encode(B.residues(spark, at), B.weights(spark, at))


def _records(spark, at, where="true"):
    lengths = B.residue_lengths(spark, at).filter(where)
    return A.records(_active(spark, at), B.residue_intervals(spark, at), lengths)


def _scores(spark, at, where="true"):
    return A.by_cluster(_records(spark, at, where))


def encode_relu(spark, at):
    return rounded(_active(spark, at))


def encode_topk(spark, at):
    return rounded(E.encode(B.residues(spark, at), B.weights(spark, at), topk=4))


def feature_stats_pass1(spark, at):
    return rounded(E.feature_stats(_active(spark, at), B.residue_lengths(spark, at)))


def _select(criterion):
    def query(spark, at):
        return rounded(E.top_features(rounded(E.feature_stats(_active(spark, at), B.residue_lengths(spark, at))), criterion, 5)).select("feature_id", criterion)

    query.__name__ = f"select_features_by_{criterion}"
    return query


def confusion_counts(spark, at):
    return A.confusion(_active(spark, at), B.residue_intervals(spark, at), B.residue_lengths(spark, at)).select(*A.PAIR, "tp", "fp", "fn", "tn")


def odds_ratio(spark, at):
    return rounded(A.confusion(_active(spark, at), B.residue_intervals(spark, at), B.residue_lengths(spark, at)).select(*A.PAIR, "odds_ratio"))


def enrichment_expected(spark, at):
    return rounded(A.confusion(_active(spark, at), B.residue_intervals(spark, at), B.residue_lengths(spark, at)).select(*A.PAIR, "expected", "enrichment"))


def _gated(spark, at):
    active, masks = _active(spark, at), B.residue_intervals(spark, at)
    return A.confusion(active, masks, B.residue_lengths(spark, at)).filter("odds_ratio >= 1.5"), active, masks


def ap_ties(spark, at):
    return rounded(A.ap_ties(*_gated(spark, at)))


def ap_rows(spark, at):
    return rounded(A.ap_rows(*_gated(spark, at)))


def alignment_scores(spark, at):
    return rounded(_scores(spark, at))


def drained_scores(spark, at):
    """The same scores in four drains, stopped after the second and taken up again."""
    folder, lengths = f"{checkpoint_dir(spark)}/drains-{uuid.uuid4().hex}", B.residue_lengths(spark, at)

    def score(part):
        own = part.select("accession")
        active, masks = (df.join(own, "accession", "left_semi") for df in (_active(spark, at), B.residue_intervals(spark, at)))
        return A.cluster_states(A.records(active, masks, part))

    drains.run(lengths, score, folder, n_drains=4, most=2)
    drains.run(lengths, score, folder, n_drains=4)
    return rounded(drains.merged(spark, folder))


def streamed_scores(spark, at):
    """Scores with a constant enrichment."""
    return rounded(A.by_cluster(A.constant_enrichment(_records(spark, at))).select("feature_id", "annot_type", "auprc_mean", "enrichment_gmean", "n_proteins", "n_clusters"))


def fisher_exact(spark, at):
    return rounded(_scores(spark, at).select("feature_id", "annot_type", "fisher_p", "odds_ratio"))


def unweighted_scores(spark, at):
    return rounded(A.unweighted(_records(spark, at), by=("feature_id", "annot_type")).drop("fisher_p", "odds_ratio"))


def per_annot_best(spark, at):
    return rounded(A.best_of(rounded(_scores(spark, at)), "annot_type").select("annot_type", "feature_id", "auprc_mean", "n_proteins", "n_clusters"))


def robust_pairs(spark, at):
    best = A.best_of(rounded(_scores(spark, at)), "annot_type")
    return A.robust(best, LEAST_PROTEINS, MOST_P, LEAST_CLUSTERS).select("annot_type", "feature_id", "auprc_mean", "fisher_p")


def feature_triage(spark, at):
    return rounded(A.triage(rounded(_scores(spark, at))))


def novel_candidates(spark, at):
    return rounded(A.novel(A.triage(rounded(_scores(spark, at))), 0.73).select("feature_id", "best_auprc", "mystery"))


def threshold_tally(spark, at):
    return rounded(A.threshold_tally(A.triage(rounded(_scores(spark, at))), [0.2, 0.4, 0.6, 0.8]))


def _halves(spark, at):
    return (rounded(_scores(spark, at, f"accession % 2 = {k}")) for k in (0, 1))


def val_test_selection(spark, at):
    return A.select_and_evaluate(*_halves(spark, at))


def selection_bias(spark, at):
    val, test = _halves(spark, at)
    return rounded(A.selection_bias(A.select_and_evaluate(val, test), test, 0.4))


def recon_metrics(spark, at):
    return rounded(E.reconstruction_metrics(B.residues(spark, at), B.weights(spark, at), B.weights(spark, at), topk=4))


def reconstructed(spark, at):
    """How far each residue's decoding is from it, and the decoding's length."""
    rows = E.reconstruction(B.residues(spark, at), B.weights(spark, at), B.weights(spark, at), topk=4)
    length = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)
    return rounded(rows.select("accession", "pos", length(F.zip_with("x", "xhat", lambda a, b: a - b)).alias("sse"), length("xhat").alias("size")))


def adjacent_cosine(spark, at):
    return rounded(E.adjacent_cosine(B.residues(spark, at)))


def mean_pool(spark, at):
    return rounded(E.pooled(B.residues(spark, at)))


def standardize(spark, at):
    return rounded(E.dimension_stats(B.residues(spark, at)))


QUERIES = {f.__name__: f for f in (
    encode_relu, encode_topk, feature_stats_pass1, *map(_select, ("mean", "variance", "max", "sparsity")), confusion_counts, odds_ratio, enrichment_expected, ap_ties, ap_rows, alignment_scores, drained_scores, streamed_scores, fisher_exact,
    unweighted_scores, per_annot_best, robust_pairs, feature_triage, novel_candidates, threshold_tally, val_test_selection, selection_bias, recon_metrics, reconstructed, adjacent_cosine, mean_pool, standardize,
)}

STATS = f"""{sql('act', 'len')}, per AS (SELECT accession, feature_id, length, sum(z) AS s, sum(z * z) AS s2, max(z) AS m, count(*) AS nz FROM act JOIN len USING (accession) GROUP BY ALL),
    f AS (SELECT feature_id, sum(s / length) AS s, sum(s2 / length) AS s2, max(m) AS mx, sum(nz / length) AS nz, (SELECT count(*) FROM len) AS n FROM per GROUP BY 1),
    stats AS (SELECT feature_id, round(s / n, 6) AS mean, round(greatest(s2 / n - s / n * (s / n), 0), 6) AS variance, round(mx, 6) AS max, round(mx / (nz / n + 1e-6), 6) AS sparsity FROM f)"""
TOPK = "top AS (SELECT accession, pos, feature_id, z FROM (SELECT *, row_number() OVER (PARTITION BY accession, pos ORDER BY z DESC, feature_id) AS k FROM dense) WHERE k <= 4 AND z > 0)"
ROUNDED = "s AS (SELECT feature_id, annot_type, round(auprc_mean, 6) AS auprc_mean, round(odds_ratio, 6) AS odds_ratio, round(fisher_p, 6) AS fisher_p, n_proteins, n_clusters FROM score)"
BEST = "best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY annot_type ORDER BY auprc_mean DESC, feature_id) = 1)"
TRIAGE = f"""{sql('score')}, {ROUNDED},
    b AS (SELECT feature_id, annot_type AS best_annot, auprc_mean AS best_auprc FROM s QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY auprc_mean DESC, annot_type) = 1),
    c AS (SELECT feature_id, count(*) AS n_types, count(*) FILTER (auprc_mean > 0.3) AS n_above_low, count(*) FILTER (auprc_mean > 0.5) AS n_above_high, max(odds_ratio) FILTER (NOT isinf(odds_ratio)) AS max_odds_ratio FROM s GROUP BY 1),
    triage AS (SELECT *, round(1 - best_auprc, 6) AS mystery FROM b JOIN c USING (feature_id))"""


def _scored(name: str, where: str) -> str:
    """The scores over some of the proteins, under the name."""
    return f"{name} AS ({sql('score', where=where)} SELECT feature_id, annot_type, round(auprc_mean, 6) AS auprc_mean, n_proteins FROM score)"


HALVES = f"""WITH {_scored('val', 'accession % 2 = 0')}, {_scored('test', 'accession % 2 = 1')},
    chosen AS (SELECT annot_type, feature_id, auprc_mean AS val_auprc FROM val QUALIFY row_number() OVER (PARTITION BY annot_type ORDER BY auprc_mean DESC, feature_id) = 1),
    eval AS (SELECT annot_type, feature_id, val_auprc, test.auprc_mean AS test_auprc, test.n_proteins AS test_proteins FROM chosen LEFT JOIN test USING (annot_type, feature_id))"""

ORACLE_SQL = {
    "encode_relu": f"{sql('act')} SELECT accession, pos, feature_id, round(z, 6) AS z FROM act",
    "encode_topk": f"{sql('dense')}, {TOPK} SELECT accession, pos, feature_id, round(z, 6) AS z FROM top",
    "feature_stats_pass1": f"{STATS} SELECT * FROM stats",
    **{f"select_features_by_{c}": f"{STATS} SELECT feature_id, {c} FROM stats ORDER BY {c} DESC, feature_id LIMIT 5" for c in ("mean", "variance", "max", "sparsity")},
    "confusion_counts": f"{sql('conf')} SELECT accession, feature_id, annot_type, tp, fp, fn, tn FROM conf",
    "odds_ratio": f"{sql('conf')} SELECT accession, feature_id, annot_type, round(odds_ratio, 6) AS odds_ratio FROM conf",
    "enrichment_expected": f"{sql('conf')} SELECT accession, feature_id, annot_type, round(expected, 6) AS expected, round(tp / nullif(expected, 0), 6) AS enrichment FROM conf",
    "ap_ties": f"{sql('ap')} SELECT accession, feature_id, annot_type, round(ap_ties, 6) AS ap FROM ap",
    "ap_rows": f"{sql('ap')} SELECT accession, feature_id, annot_type, round(ap_rows, 6) AS ap FROM ap",
    "alignment_scores": f"""{sql('score')} SELECT feature_id, annot_type, round(auprc_mean, 6) AS auprc_mean, round(auprc_median, 6) AS auprc_median, round(enrichment_gmean, 6) AS enrichment_gmean,
        round(tp, 6) AS tp, round(fp, 6) AS fp, round(fn, 6) AS fn, round(tn, 6) AS tn, n_proteins, n_clusters, round(odds_ratio, 6) AS odds_ratio, round(fisher_p, 6) AS fisher_p FROM score""",
    "streamed_scores": f"{sql('score')} SELECT feature_id, annot_type, round(auprc_mean, 6) AS auprc_mean, CAST(1 AS DOUBLE) AS enrichment_gmean, n_proteins, n_clusters FROM score",
    "fisher_exact": f"{sql('score')} SELECT feature_id, annot_type, round(fisher_p, 6) AS fisher_p, round(odds_ratio, 6) AS odds_ratio FROM score",
    "unweighted_scores": f"""{sql('score')} SELECT feature_id, annot_type, round(avg(ap), 6) AS auprc_mean, round(median(ap), 6) AS auprc_median, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp,
        CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tn) AS BIGINT) AS tn, count(*) AS n_proteins FROM rec GROUP BY 1, 2""",
    "per_annot_best": f"{sql('score')}, {ROUNDED}, {BEST} SELECT annot_type, feature_id, auprc_mean, n_proteins, n_clusters FROM best",
    "robust_pairs": f"{sql('score')}, {ROUNDED}, {BEST} SELECT annot_type, feature_id, auprc_mean, fisher_p FROM best WHERE n_proteins >= {LEAST_PROTEINS} AND fisher_p < {MOST_P} AND n_clusters >= {LEAST_CLUSTERS}",
    "feature_triage": f"{TRIAGE} SELECT * FROM triage",
    "novel_candidates": f"{TRIAGE} SELECT feature_id, best_auprc, mystery FROM triage WHERE best_auprc < 0.73",
    "threshold_tally": f"""{TRIAGE} SELECT cut, count(*) FILTER (best_auprc < cut) AS n_below, round(avg(CASE WHEN best_auprc < cut THEN 1.0 ELSE 0 END), 6) AS share_below
        FROM triage, (SELECT unnest([0.2, 0.4, 0.6, 0.8])::DOUBLE AS cut) GROUP BY cut""",
    "val_test_selection": f"{HALVES} SELECT * FROM eval",
    "selection_bias": f"""{HALVES}, naive AS (SELECT annot_type, max(auprc_mean) AS naive FROM test GROUP BY 1)
        SELECT count(*) AS n_types, count(test_auprc) AS n_evaluated, round(avg(val_auprc), 6) AS val_mean, round(avg(test_auprc), 6) AS test_mean, round(avg(val_auprc - test_auprc), 6) AS gap,
            round(avg(naive), 6) AS naive_mean, round(avg(naive - test_auprc), 6) AS naive_gap, count(*) FILTER (val_auprc >= 0.4) AS n_high_val, count(*) FILTER (test_auprc >= 0.4) AS n_high_test
        FROM eval LEFT JOIN naive USING (annot_type)""",
    "recon_metrics": f"""{sql('dense')}, {TOPK}, part AS (SELECT accession, pos, unnest(range(1, len(w) + 1)) AS dim, unnest(w) * z AS v FROM top JOIN w USING (feature_id)),
        hat AS (SELECT accession, pos, dim, sum(v) AS y FROM part GROUP BY ALL),
        xs AS (SELECT accession, pos, unnest(range(1, len(x) + 1)) AS dim, unnest(x) AS x FROM res),
        both_ AS (SELECT dim, x, coalesce(y, 0) AS y FROM xs LEFT JOIN hat USING (accession, pos, dim)),
        d AS (SELECT dim, sum((x - y) * (x - y)) AS sse, var_pop(x) AS var, count(*) AS n FROM both_ GROUP BY dim),
        a AS (SELECT count(*) AS nz, sum(z) AS z, count(DISTINCT feature_id) AS alive FROM top)
        SELECT round(sum(sse) / sum(n), 6) AS mse, round(any_value(nz) / max(n), 6) AS l0, round(any_value(z) / (max(n) * {B.FEATURES}), 6) AS mean_abs_z, round(1 - any_value(alive) / {B.FEATURES}, 6) AS dead_share,
            round(1 - sum(sse) / sum(var * n), 6) AS r2 FROM d, a""",
    "reconstructed": f"""{sql('dense')}, {TOPK}, part AS (SELECT accession, pos, unnest(range(1, len(w) + 1)) AS dim, unnest(w) * z AS v FROM top JOIN w USING (feature_id)),
        hat AS (SELECT accession, pos, dim, sum(v) AS y FROM part GROUP BY ALL),
        xs AS (SELECT accession, pos, unnest(range(1, len(x) + 1)) AS dim, unnest(x) AS x FROM res)
        SELECT accession, pos, round(sum((x - coalesce(y, 0)) ** 2), 6) AS sse, round(sum(coalesce(y, 0) ** 2), 6) AS size FROM xs LEFT JOIN hat USING (accession, pos, dim) GROUP BY 1, 2""",
    "adjacent_cosine": f"""{sql('res')}, p AS (SELECT accession, pos, x, lead(x) OVER o AS y, lead(pos) OVER o AS next_pos FROM res WINDOW o AS (PARTITION BY accession ORDER BY pos))
        SELECT accession, pos, round(list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))), 6) AS cosine FROM p WHERE next_pos = pos + 1""",
    "mean_pool": f"{sql('res')}, d AS (SELECT accession, unnest(range(0, len(x))) AS dim, unnest(x) AS v FROM res) SELECT accession, CAST(dim AS INT) AS dim, round(avg(v), 6) AS v FROM d GROUP BY 1, 2",
    "standardize": f"{sql('res')}, d AS (SELECT unnest(range(0, len(x))) AS dim, unnest(x) AS v FROM res) SELECT CAST(dim AS INT) AS dim, round(avg(v), 6) AS mean, round(greatest(stddev_pop(v), 1e-6), 6) AS sd FROM d GROUP BY 1",
}
ORACLE_SQL["drained_scores"] = ORACLE_SQL["alignment_scores"]
