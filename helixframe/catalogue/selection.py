"""Queries that choose types, pairs and keys, and evidence put together."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.catalogue import alignment as Q
from helixframe.catalogue import reports as R
from helixframe.catalogue.prep import SPLIT, split_members
from helixframe.functions import columns as C
from helixframe.functions.scales import scale_table
from helixframe.operators import alignment, attention, autoencoder, encoding, evidence, selection
from helixframe.plans import bindings as B
from helixframe.plans.bindings import rounded, sql

#: Thresholds that fit scores over a few hundred proteins; the operators' own defaults are for real ones.
LEAST_BEST, HIGH, MOST_HIGH = 0.3, 0.9, 8


def _best(spark, at):
    return alignment.best_of(rounded(Q._scores(spark, at)), "annot_type")


def mystery_score(spark, at):
    best = alignment.best_of(rounded(Q._scores(spark, at)), "feature_id", tie="annot_type")
    return rounded(best.select("feature_id", C.mystery(F.col("auprc_mean")).alias("mystery")))


def pair_precision(spark, at):
    scored = rounded(Q._scores(spark, at))
    return rounded(scored.select("feature_id", "annot_type", C.precision(F.col("tp"), F.col("fp")).alias("precision"), C.per_protein(F.col("tp"), F.col("n_proteins")).alias("residues_per_protein")))


def robust_without_clusters(spark, at):
    return alignment.robust(_best(spark, at), Q.LEAST_PROTEINS, Q.MOST_P, None).select("annot_type", "feature_id", "auprc_mean", "fisher_p")


def _named(spark, at):
    """Scores with types as texts of a prefix and a name."""
    return rounded(Q._scores(spark, at)).withColumn("annot_type", F.concat((F.col("annot_type") % 7).cast("string"), F.lit(": "), F.col("annot_type").cast("string")))


def figure_types(spark, at):
    return selection.figure_types(selection.precise(_named(spark, at)), LEAST_BEST, HIGH, MOST_HIGH)


def feature_owners(spark, at):
    scores = selection.precise(_named(spark, at))
    return selection.owners(selection.figure_types(scores, LEAST_BEST, HIGH, MOST_HIGH), scores)


def robust_types(spark, at):
    scores = rounded(Q._scores(spark, at)).select("feature_id", "annot_type", "auprc_mean", "n_clusters")
    return selection.of_robust_types(scores, _best(spark, at), least_clusters=6)


def top_pairs_above(spark, at):
    return selection.above(rounded(Q._scores(spark, at)), 0.3, 20).select("feature_id", "annot_type", "auprc_mean")


def layer_rows(spark, at):
    scores = rounded(R._attention_scores(spark, at)).filter(selection.anchored("attn_agg", r"layer_\d+_sent"))
    return scores.select("annot_type", F.regexp_extract("attn_agg", r"^layer_(\d+)_sent", 1).cast("int").alias("layer"), "auprc_mean")


def varied_types(spark, at):
    return rounded(attention.varied(layer_rows(spark, at).withColumnRenamed("auprc_mean", "auprc"), 4, 0.02, 0.1))


def described_subtypes(spark, at):
    rows = selection.described(B.enriched(spark, at))
    return rows.groupBy("annot_subtype").agg(F.count_distinct("accession").alias("n_proteins")).orderBy(F.desc("n_proteins"), "annot_subtype").limit(30)


def counts_with_length(spark, at):
    return selection.counted_with(B.annotations(spark, at), B.lengths(spark, at))


def best_with_counts(spark, at):
    out = selection.with_group_size(_best(spark, at), Q._scores(spark, at), "annot_type", "n_features")
    return out.select("annot_type", "feature_id", "auprc_mean", "n_features")


def carried_split(spark, at):
    return selection.carried(split_members(spark, at), "cluster_id", ["split"])


def capped_key_union(spark, at):
    return selection.capped_keys(B.annotations(spark, at), 100)


def largest_effects(spark, at):
    return selection.by_magnitude(R.cohen_d(spark, at).select("feature_id", "cohen_d"), "cohen_d", "feature_id", 5)


def feature_means(spark, at):
    rows = R.evidence.structural_alignment(B.residues(spark, at), B.residue_masks(spark, at), B.weights(spark, at))
    return rounded(rows.groupBy("feature_id").agg(F.avg("cosine").alias("mean_cosine"), F.count("cosine").alias("n_types")), 5)


def length_histogram(spark, at):
    return selection.histogram(B.proteins(spark, at), "length")


def evidence_scorecard(spark, at):
    scores = rounded(Q._scores(spark, at)).filter("annot_type = 3").select("feature_id", "auprc_mean")
    causal = R.ablation_contrast(spark, at).select("feature_id", "frac_positive")
    shape = R.structural_alignment(spark, at).filter("annot_type = 3").select("feature_id", "cosine")
    rows = scores.join(causal, "feature_id", "left").join(shape, "feature_id", "left")
    return evidence.scorecard(rows).select("feature_id", "pass_auprc", "pass_ablation", "pass_structure", "n_passed")


def _letters(spark, at):
    """The letters of the bound proteins' residues: as many of each text as it has vectors."""
    lengths = B.residue_lengths(spark, at).select("accession", "length")
    texts = B.proteins(spark, at).select("accession", F.regexp_replace("sequence", "[^ -~]", "").alias("sequence")).join(lengths, "accession")
    return evidence.letters(texts.select("accession", F.expr("substring(sequence, 1, length)").alias("sequence")))


def feature_physico(spark, at):
    """Per feature the property whose effect is largest where it is active."""
    rows = evidence.feature_letters(encoding.encode(B.residues(spark, at), B.weights(spark, at)), _letters(spark, at), B.weights(spark, at))
    effects = evidence.physico_contrast(rows, scale_table(spark), ["feature_id"])
    return rounded(effects.groupBy("feature_id").agg(F.max(F.abs("cohen_d")).alias("max_abs_d")))


def full_scorecard(spark, at):
    """All six rules for the features of type 3."""
    scores = rounded(Q._scores(spark, at))
    own = scores.filter("annot_type = 3").select("feature_id", "annot_type", "auprc_mean")
    others = evidence.convergence(scores, own.select("feature_id", "annot_type"), 5).groupBy(F.col("focal_id").alias("feature_id")).agg(F.count("*").alias("n_features"))
    causal = R.ablation_contrast(spark, at).select("feature_id", "frac_positive")
    shape = R.structural_alignment(spark, at).filter("annot_type = 3").select("feature_id", "cosine")
    logit = logit_delta(spark, at).agg(F.avg((F.col("delta") > 0).cast("double")).alias("logit_frac")).select(F.lit(0).cast("long").alias("feature_id"), F.round("logit_frac", 6).alias("logit_frac"))
    rows = own
    for part in (others, causal, shape, feature_physico(spark, at), logit):
        rows = rows.join(part, "feature_id", "left")
    return evidence.scorecard(rows).select("feature_id", "pass_auprc", "pass_physico", "pass_ablation", "pass_convergence", "pass_structure", "pass_logit", "n_passed")


def case_tracks(spark, at):
    """Every residue of each feature's best protein."""
    active, masks, lengths = R._evidence(spark, at)
    cases = evidence.best_contrasts(active, masks, lengths, B.weights(spark, at))
    return rounded(evidence.case_tracks(active, masks, _letters(spark, at), cases))


def logit_delta(spark, at):
    """A vector as the logits of a position, its label as the token, and the first feature's part taken out."""
    rows, w = B.residues(spark, at), B.weights(spark, at).filter("feature_id = 0")
    logits = rows.select("accession", "pos", F.col("annot_type").alias("token"), F.col("x").alias("logits"))
    active = encoding.encode(rows, w)
    part = rows.join(active, ["accession", "pos"], "left").join(F.broadcast(w.select(F.col("w").alias("d"))))
    less = F.zip_with("x", "d", lambda a, b: a - F.coalesce(F.col("z"), F.lit(0.0)) * b)
    return rounded(evidence.logit_delta(logits, part.select("accession", "pos", less.alias("logits"))))


def sae_training(spark, at):
    """The log of every architecture, a third of the proteins held out."""
    rows = B.residues(spark, at)
    held_out = F.pmod(F.xxhash64("accession"), F.lit(3)) == 0
    base = autoencoder.Config(latents=128, k=16, epochs=6, batch=64, rate=3e-3)
    models = autoencoder.fan_out(rows.filter(~held_out), ["vanilla", "topk", "matryoshka", "temporal"], base, rows.filter(held_out))
    log = [(arch, e["epoch"], e["loss"], e["mse"], e["l0"], e["dead_frac"], e["alive_frac"], e["ever_active_frac"], e["val_mse"], e["val_r2"]) for arch, m in models.items() if m for e in m.log]
    return rounded(spark.createDataFrame(log, "arch string, epoch int, loss double, mse double, l0 double, dead_frac double, alive_frac double, ever_active_frac double, val_mse double, val_r2 double"))


QUERIES = {f.__name__: f for f in (
    mystery_score, pair_precision, robust_without_clusters, figure_types, feature_owners, robust_types, top_pairs_above, layer_rows, varied_types, described_subtypes, counts_with_length, best_with_counts,
    carried_split, capped_key_union, largest_effects, feature_means, length_histogram, evidence_scorecard, feature_physico, full_scorecard, case_tracks, logit_delta, sae_training,
)}

_S = f"{sql('score')}, {Q.ROUNDED}"
_FIRST = """cut AS (SELECT accession, count(*) AS n FROM res GROUP BY 1),
    tx AS (SELECT accession, upper(substr(regexp_replace(sequence, '[^ -~]', '', 'g'), 1, CAST(n AS INT))) AS t FROM proteins JOIN cut USING (accession)),
    first AS (SELECT accession, unnest(string_split(t, '')) AS residue, unnest(range(1, length(t) + 1)) AS pos FROM tx WHERE t <> '')"""
_PHYSICO = f"""{sql('dense', 'proteins')}, {_FIRST}, sc(residue, property, value) AS (VALUES {R._SCALES}),
    cells AS (SELECT feature_id, property, z > 0.1 AS inside, value FROM first JOIN dense USING (accession, pos) JOIN sc USING (residue)),
    ms AS (SELECT feature_id, property, avg(value) FILTER (inside) AS mi, avg(value) FILTER (NOT inside) AS mo, stddev_pop(value) FILTER (inside) AS si, stddev_pop(value) FILTER (NOT inside) AS so FROM cells GROUP BY 1, 2),
    physico AS (SELECT feature_id, round(max(abs(CASE WHEN si * si + so * so > 0 THEN (mi - mo) / sqrt((si * si + so * so) / 2) ELSE 0 END)), 6) AS max_abs_d FROM ms GROUP BY 1)"""
_COSINE = "sum(d * w) / (sqrt(sum(d * d)) * sqrt(sum(w * w)))"
UNROUNDED = R.ORACLE_SQL["structural_alignment"].replace(f"round({_COSINE}, 6)", _COSINE)
TYPES = f"""{sql('score')}, named AS (SELECT CAST(annot_type % 7 AS VARCHAR) || ': ' || CAST(annot_type AS VARCHAR) AS annot_type, feature_id, round(auprc_mean, 6) AS auprc_mean FROM score WHERE tp / (tp + fp + 1e-9) >= 0.05),
    t0 AS (SELECT annot_type, max(auprc_mean) AS best, count(DISTINCT feature_id) FILTER (auprc_mean > {HIGH}) AS n_high FROM named GROUP BY 1),
    types AS (SELECT annot_type, best FROM t0 WHERE best > {LEAST_BEST} AND n_high <= {MOST_HIGH} QUALIFY row_number() OVER (PARTITION BY split_part(annot_type, ':', 1) ORDER BY best DESC, annot_type) = 1)"""
LAYERS = f"{sql('res')}, {R.ATTENTION}, lr AS (SELECT annot_type, CAST(regexp_extract(attn_agg, '^layer_(\\d+)_sent', 1) AS INT) AS layer, auprc_mean FROM ascore WHERE regexp_matches(attn_agg, '^layer_\\d+_sent'))"

ORACLE_SQL = {
    "mystery_score": f"{_S} SELECT feature_id, round(1 - max(auprc_mean), 6) AS mystery FROM s GROUP BY 1",
    "pair_precision": f"{sql('score')} SELECT feature_id, annot_type, round(round(tp, 6) / (round(tp, 6) + round(fp, 6) + 1e-9), 6) AS precision, round(round(tp, 6) / (n_proteins + 1e-9), 6) AS residues_per_protein FROM score",
    "robust_without_clusters": f"{_S}, {Q.BEST} SELECT annot_type, feature_id, auprc_mean, fisher_p FROM best WHERE n_proteins >= {Q.LEAST_PROTEINS} AND fisher_p < {Q.MOST_P}",
    "figure_types": f"{TYPES} SELECT annot_type, best FROM types",
    "feature_owners": f"""{TYPES.replace('WITH', 'WITH RECURSIVE', 1)}, ch AS (SELECT annot_type, feature_id, row_number() OVER (PARTITION BY annot_type ORDER BY auprc_mean DESC, feature_id) AS nth FROM named),
        tn AS (SELECT row_number() OVER (ORDER BY best DESC, types.annot_type) AS r, types.annot_type, best, a.feature_id AS f1, b.feature_id AS f2
            FROM types JOIN ch a ON a.annot_type = types.annot_type AND a.nth = 1 LEFT JOIN ch b ON b.annot_type = types.annot_type AND b.nth = 2),
        go AS (SELECT CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS VARCHAR) AS annot_type, CAST(NULL AS DOUBLE) AS best, CAST(NULL AS BIGINT) AS feature_id
            UNION ALL SELECT r, CASE WHEN f IS NULL THEN taken ELSE list_append(taken, f) END, annot_type, best, f
            FROM (SELECT tn.r, taken, tn.annot_type, tn.best, CASE WHEN NOT list_contains(taken, f1) THEN f1 WHEN f2 IS NOT NULL AND NOT list_contains(taken, f2) THEN f2 END AS f FROM go JOIN tn ON tn.r = go.r + 1))
        SELECT annot_type, feature_id, best FROM go WHERE feature_id IS NOT NULL""",
    "robust_types": f"{_S}, {Q.BEST} SELECT feature_id, annot_type, auprc_mean, n_clusters FROM s WHERE annot_type IN (SELECT annot_type FROM best WHERE n_clusters >= 6)",
    "top_pairs_above": f"{_S} SELECT feature_id, annot_type, auprc_mean FROM s WHERE auprc_mean >= 0.3 ORDER BY auprc_mean DESC, feature_id, annot_type LIMIT 20",
    "layer_rows": f"{LAYERS} SELECT * FROM lr",
    "varied_types": f"""{LAYERS}, sp AS (SELECT annot_type, max(auprc_mean) - min(auprc_mean) AS range, max(auprc_mean) AS peak FROM lr GROUP BY 1), ok AS (SELECT *, range > 0.02 AND peak > 0.1 AS enough FROM sp)
        SELECT annot_type, round(range, 6) AS range, round(peak, 6) AS peak FROM ok WHERE enough = (SELECT bool_or(enough) FROM ok) ORDER BY ok.range DESC, annot_type LIMIT 4""",
    "described_subtypes": f"{sql('enriched')} SELECT annot_subtype, count(DISTINCT accession) AS n_proteins FROM enriched WHERE annot_subtype <> feature_type GROUP BY 1 ORDER BY n_proteins DESC, annot_subtype LIMIT 30",
    "counts_with_length": f"{sql('ann', 'lengths')} SELECT accession, count(*) AS n, CAST(any_value(length) AS INT) AS length FROM ann JOIN lengths USING (accession) GROUP BY 1",
    "best_with_counts": f"{_S}, {Q.BEST} SELECT annot_type, feature_id, auprc_mean, (SELECT count(*) FROM s WHERE s.annot_type = best.annot_type) AS n_features FROM best",
    "carried_split": f"{sql('members')}, {SPLIT} SELECT cluster_id, split FROM split",
    "capped_key_union": f"{sql('ann')}, k AS (SELECT DISTINCT feature_type, accession FROM ann), c AS (SELECT accession FROM k QUALIFY row_number() OVER (PARTITION BY feature_type ORDER BY accession) <= 100) SELECT DISTINCT accession FROM c",
    "largest_effects": f"SELECT feature_id, cohen_d FROM ({R.ORACLE_SQL['cohen_d']}) ORDER BY abs(cohen_d) DESC, feature_id LIMIT 5",
    "feature_means": f"SELECT feature_id, round(avg(cosine), 5) AS mean_cosine, count(cosine) AS n_types FROM ({UNROUNDED}) GROUP BY 1",
    "length_histogram": f"""{sql('proteins')}, b AS (SELECT CAST(min(length) AS DOUBLE) AS lo, CAST(max(length) AS DOUBLE) AS hi FROM proteins), e AS (SELECT *, hi / (lo + 1) > 100 AS wide FROM b),
        x AS (SELECT CASE WHEN wide THEN (log10(nullif(length, 0)) - log10(lo + 1)) / ((log10(hi + 1) - log10(lo + 1)) / 49) ELSE (length - lo) / ((hi - lo) / 40) END AS x, CASE WHEN wide THEN 48 ELSE 39 END AS last FROM proteins, e)
        SELECT CAST(least(floor(round(x, 9)), last) AS INT) AS bin, count(*) AS n FROM x WHERE x IS NOT NULL AND round(x, 9) >= 0 GROUP BY 1""",
    "evidence_scorecard": f"""SELECT feature_id, auprc_mean > 0.3 AS pass_auprc, coalesce(frac_positive > 0.6, false) AS pass_ablation, coalesce(cosine > 0.1, false) AS pass_structure,
            CAST(auprc_mean > 0.3 AS INT) + CAST(coalesce(frac_positive > 0.6, false) AS INT) + CAST(coalesce(cosine > 0.1, false) AS INT) AS n_passed
        FROM (SELECT feature_id, auprc_mean FROM ({Q.ORACLE_SQL['alignment_scores']}) WHERE annot_type = 3) LEFT JOIN (SELECT feature_id, frac_positive FROM ({R.ORACLE_SQL['ablation_contrast']})) USING (feature_id)
            LEFT JOIN (SELECT feature_id, cosine FROM ({R.ORACLE_SQL['structural_alignment']}) WHERE annot_type = 3) USING (feature_id)""",
    "feature_physico": f"{_PHYSICO} SELECT feature_id, max_abs_d FROM physico",
    "full_scorecard": f"""WITH s AS (SELECT feature_id, annot_type, auprc_mean FROM ({Q.ORACLE_SQL['alignment_scores']})),
        n AS (SELECT a.feature_id, least(count(*), 5) AS n_features FROM s a JOIN s b ON a.annot_type = b.annot_type AND a.feature_id <> b.feature_id WHERE a.annot_type = 3 GROUP BY 1),
        l AS (SELECT 0 AS feature_id, avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0 END) AS logit_frac FROM ({{logit}})),
        r AS (SELECT feature_id, auprc_mean > 0.3 AS pass_auprc, coalesce(max_abs_d > 0.2, false) AS pass_physico, coalesce(frac_positive > 0.6, false) AS pass_ablation, coalesce(n_features >= 3, false) AS pass_convergence,
                coalesce(cosine > 0.1, false) AS pass_structure, coalesce(logit_frac > 0.6, false) AS pass_logit
            FROM (SELECT * FROM s WHERE annot_type = 3) LEFT JOIN n USING (feature_id) LEFT JOIN (SELECT feature_id, frac_positive FROM ({R.ORACLE_SQL['ablation_contrast']})) USING (feature_id)
            LEFT JOIN (SELECT feature_id, cosine FROM ({R.ORACLE_SQL['structural_alignment']}) WHERE annot_type = 3) USING (feature_id) LEFT JOIN ({_PHYSICO} SELECT feature_id, max_abs_d FROM physico) USING (feature_id) LEFT JOIN l USING (feature_id))
        SELECT *, CAST(pass_auprc AS INT) + CAST(pass_physico AS INT) + CAST(pass_ablation AS INT) + CAST(pass_convergence AS INT) + CAST(pass_structure AS INT) + CAST(pass_logit AS INT) AS n_passed FROM r""",
    "case_tracks": f"""{sql('dense', 'proteins')}, p AS (SELECT accession, feature_id, round(coalesce(avg(z) FILTER (annot_type = 3), 0) - coalesce(avg(z) FILTER (annot_type <> 3), 0), 6) AS contrast, count(*) FILTER (annot_type = 3) AS n
            FROM dense GROUP BY ALL HAVING n > 0),
        best AS (SELECT feature_id, accession FROM p QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY contrast DESC, accession) = 1), {_FIRST}
        SELECT feature_id, accession, pos, residue, round(z, 6) AS z, round(z / greatest(max(z) OVER (PARTITION BY feature_id, accession), 1e-8), 6) AS shade, CAST(annot_type = 3 AS INT) AS annotated, residue IN ('C', 'H') AS bold
        FROM best JOIN first USING (accession) JOIN dense USING (feature_id, accession, pos)""",
    "logit_delta": f"""{sql('dense')}, l AS (SELECT d.accession, d.pos, d.annot_type AS token, r.x AS a, list_transform(list_zip(r.x, w.w), lambda p: p[1] - d.z * p[2]) AS b
            FROM dense d JOIN res r ON r.accession = d.accession AND r.pos = d.pos JOIN w ON w.feature_id = d.feature_id WHERE d.feature_id = 0)
        SELECT accession, pos, round((a[token + 1] - ln(list_sum(list_transform(a, lambda v: exp(v))))) - (b[token + 1] - ln(list_sum(list_transform(b, lambda v: exp(v))))), 6) AS delta FROM l""",
}
ORACLE_SQL["full_scorecard"] = ORACLE_SQL["full_scorecard"].format(logit=ORACLE_SQL["logit_delta"])
