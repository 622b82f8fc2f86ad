"""Queries behind reports, figures, evidence and attention."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from helixframe.catalogue import alignment as Q
from helixframe.catalogue.prep import SPLIT, cluster_subset, split_members
from helixframe.functions import columns as C
from helixframe.functions.metrics import r_squared
from helixframe.functions.scales import EVIDENCE, scale_table
from helixframe.operators import alignment, attention, encoding, evidence, intervals, reports
from helixframe.operators.prep import RESIDUES
from helixframe.plans import bindings as B
from helixframe.plans.bindings import rounded, sql
from helixframe.plans.staging import table
from helixframe.streaming import running


def split_summary_pct(spark, at):
    return rounded(reports.split_summary(split_members(spark, at)))


def length_stats(spark, at):
    rows = B.proteins(spark, at)
    return rounded(rows.groupBy("lang").agg(F.count("*").alias("n"), F.avg("length").alias("mean"), F.median("length").alias("median"), F.stddev_samp("length").alias("std"), F.min("length").alias("min"), F.max("length").alias("max")))


def length_describe(spark, at):
    return rounded(reports.describe(B.proteins(spark, at), "length"))


def value_counts(spark, at):
    return rounded(reports.value_counts(B.annotations(spark, at), "feature_type"))


def leakage_report(spark, at):
    return reports.leakage(split_members(spark, at), B.annotations(spark, at).select("accession", "feature_type", "start", "end"))


def subset_checks(spark, at):
    whole = B.members(spark, at)
    return reports.subset_checks(whole.join(cluster_subset(spark, at), "cluster_id", "left_semi"), whole)


def _typed(spark, at):
    return B.annotations(spark, at).join(split_members(spark, at).select("accession", "split"), "accession")


def type_by_split_pivot(spark, at):
    return reports.by_split(_typed(spark, at), "feature_type")


def pivot_row_norm(spark, at):
    return rounded(reports.row_shares(type_by_split_pivot(spark, at)))


def split_deviation(spark, at):
    out = reports.deviation(reports.row_shares(type_by_split_pivot(spark, at)), {"train": 0.7, "val": 0.15, "test": 0.15})
    return rounded(out.select("feature_type", "dev_train", "dev_val", "dev_test", "max_deviation"))


def top_types(spark, at):
    return B.enriched(spark, at).groupBy("annot_subtype").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "annot_subtype").limit(10)


def top_subtypes_per_type(spark, at):
    return reports.top_per_group(B.enriched(spark, at), "feature_type", "annot_subtype", 5)


def mean_features_per_protein(spark, at):
    return rounded(reports.mean_per_member(B.annotations(spark, at)))


def density_per_100(spark, at):
    per = B.annotations(spark, at).groupBy("accession").agg(F.count("*").alias("n")).join(B.lengths(spark, at), "accession")
    return rounded(per.select("accession", C.density(F.col("n"), F.col("length")).alias("density")))


def relative_position_hist(spark, at):
    rows = intervals.with_geometry(B.annotations(spark, at), B.lengths(spark, at))
    return rows.withColumn("bin", C.histogram_bin(F.round("relative", 9), 0.0, 1.0, 16)).filter("bin is not null").groupBy("feature_type", "bin").agg(F.count("*").alias("n"))


def position_ridge(spark, at):
    rows = intervals.with_geometry(B.annotations(spark, at), B.lengths(spark, at))
    return rounded(reports.density_ridge(rows, "feature_type", "relative"), 5)


def smoothed_tracks(spark, at):
    """Suppliers as sequences of their lines, averaged over a fiftieth of their length and scaled."""
    order = Window.partitionBy("supplier").orderBy("l_orderkey", "l_linenumber", "l_partkey", "v")
    lines = table(spark, at, "lineitem").select(F.col("l_suppkey").alias("supplier"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("double").alias("v")).withColumn("pos", F.row_number().over(order))
    smooth = reports.width_average(lines.select("supplier", "pos", "v"), "v", ["supplier"])
    return rounded(reports.scaled(rounded(smooth, 9), "smooth", ["supplier"]).select("supplier", "pos", "length", "smooth", "score"), 5)


def contour_segments(spark, at):
    """Outlines of types over twenty bins of each sequence."""
    apart = intervals.merged_types(B.annotations(spark, at), B.lengths(spark, at), ("length",))
    return intervals.contour(intervals.binned_share(apart, None, ["accession", "annot_type"], 20), ["accession", "annot_type"])


def cooccurrence(spark, at):
    return intervals.type_pairs(B.annotations(spark, at))


def log_bins_2d(spark, at):
    rows = B.annotations(spark, at).join(table(spark, at, "part").select(F.col("p_partkey").alias("part"), "p_retailprice"), "part")
    return reports.counts_2d(rows, reports.log_bins(F.col("end") - F.col("start") + 1), reports.log_bins(F.col("p_retailprice")))


def median_trend(spark, at):
    return rounded(reports.median_trend(B.annotations(spark, at).withColumn("span", F.col("end") - F.col("start") + 1), F.col("start"), "span"))


def _plain(spark, at):
    """Sequences without characters whose upper case is not one letter everywhere."""
    return B.proteins(spark, at).select("accession", F.regexp_replace("sequence", "[^ -~]", "").alias("sequence"))


def char_frequency(spark, at):
    return rounded(reports.letter_frequency(_plain(spark, at), RESIDUES))


def prefix_owners(spark, at):
    scores = rounded(Q._scores(spark, at)).withColumn("annot_type", F.concat((F.col("annot_type") % 3).cast("string"), F.lit(": "), F.col("annot_type").cast("string")))
    return reports.prefix_owners(scores, 3).select("annot_type", "feature_id", "auprc_mean")


def _lettered(spark, at):
    letters = evidence.letters(_plain(spark, at)).filter(F.col("residue").isin(*RESIDUES, "X"))
    return letters.withColumn("inside", (F.col("pos") % 5 == 0).cast("int"))


def physico_contrast(spark, at):
    return rounded(evidence.physico_contrast(_lettered(spark, at), scale_table(spark)))


def _evidence(spark, at):
    """Activations, the intervals of type 3, and lengths."""
    active = encoding.encode(B.residues(spark, at), B.weights(spark, at))
    return active, B.residue_intervals(spark, at).filter("annot_type = 3").select("accession", "a", "b"), B.residue_lengths(spark, at)


def _norms(spark, at):
    return B.weights(spark, at).select("feature_id", F.sqrt(F.aggregate("w", F.lit(0.0), lambda s, x: s + x * x)).alias("norm"))


def ablation_contrast(spark, at):
    return rounded(evidence.ablation_summary(*_evidence(spark, at), _norms(spark, at)))


def cohen_d(spark, at):
    return rounded(evidence.sparse_contrast(*_evidence(spark, at), B.weights(spark, at)).select("feature_id", "mean_in", "mean_out", "cohen_d", "n_in"))


def precision_recall(spark, at):
    return rounded(evidence.sparse_precision_recall(*_evidence(spark, at), B.weights(spark, at), 0.1))


def self_ablation(spark, at):
    active = encoding.encode(B.residues(spark, at), B.weights(spark, at))
    per = evidence.self_ablation(active, B.residue_lengths(spark, at))
    return rounded(per.groupBy("feature_id").agg(F.avg("contrast").alias("abl_contrast"), F.count("*").alias("n")))


def triage_quadrants(spark, at):
    triaged = Q.feature_triage(spark, at).join(self_ablation(spark, at).select("feature_id", "abl_contrast"), "feature_id", "left")
    return evidence.quadrants(triaged, 0.6, 0.25).select("feature_id", "best_auprc", "abl_contrast", "quadrant")


def structural_alignment(spark, at):
    return rounded(evidence.structural_alignment(B.residues(spark, at), B.residue_masks(spark, at), B.weights(spark, at)))


def convergence_topn(spark, at):
    scores = rounded(Q._scores(spark, at))
    return evidence.convergence(scores, alignment.best_of(scores, "annot_type"), 3).select("focal_id", "annot_type", "feature_id", "auprc_mean", "nth")


def regime_quantile_filter(spark, at):
    scored = rounded(evidence.regimes(Q._scores(spark, at), 1.2))
    return evidence.regime_filter(scored, 0.1, {"domain": 3, "motif": 2}).select("feature_id", "annot_type", "precision", "residues_per_protein", "regime")


def regime_balanced(spark, at):
    scored = rounded(evidence.regimes(Q._scores(spark, at), 1.2))
    return evidence.balanced(scored, 10).select("regime", "feature_id", "annot_type", "auprc_mean", "nth")


def regime_gmm(spark, at):
    scores = Q._scores(spark, at)
    return rounded(spark.createDataFrame([(evidence.regime_threshold(scores),)], "threshold double"), 5)


def positional_profile(spark, at):
    active, _, lengths = _evidence(spark, at)
    return rounded(evidence.positional_profile(active, lengths, B.weights(spark, at), bins=6))


def resample_bins(spark, at):
    active, _, lengths = _evidence(spark, at)
    return rounded(evidence.filled(evidence.resampled(active, lengths, bins=7), lengths, B.weights(spark, at), 7))


def minmax_norm(spark, at):
    rows = table(spark, at, "events")
    return rounded(reports.scaled(rows, "value", ["event_type"]).select("event_id", "score"))


def quantile_gate(spark, at):
    return attention.gated(table(spark, at, "events").select("event_id", "event_type", "value"), ["event_type"], value="value").select("event_id", "on")


def moving_average(spark, at):
    rows = table(spark, at, "events")
    return rounded(rows.select("event_id", reports.moving_average(rows, "value", ["user_id"], "event_id", 5).alias("smooth")))


#: Residues, each with its vector, of a task that makes attention weights.
RESIDUES_OF_TASK = 5_000


def _attention(spark, at):
    """Weights of two layers and two heads between the residues of a protein, from their products; proteins are dealt out by the number of residues."""
    own = B.residues(spark, at).select("accession", "pos", "x")
    own = own.repartition(intervals.tasks_for(table(spark, at, "embeddings"), RESIDUES_OF_TASK), "accession")
    other = own.select("accession", F.col("pos").alias("key"), F.col("x").alias("y"))
    pairs = own.withColumnRenamed("pos", "query").join(other.hint("merge"), "accession")
    head = F.explode(F.array(*[F.struct(F.lit(layer).alias("layer"), F.lit(h).alias("head"), F.lit(32 * (layer - 1) + 16 * (h - 1) + 1).alias("at")) for layer in (1, 2) for h in (1, 2)]))
    parts = pairs.select("accession", "query", "key", "x", "y", head.alias("h"))
    part = lambda c: F.slice(c, F.col("h.at"), 16)
    weight = F.round(F.abs(F.aggregate(F.zip_with(part("x"), part("y"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)), 9)
    return parts.select("accession", "h.layer", "h.head", "query", "key", weight.alias("weight"))


def attention_reduce(spark, at):
    return rounded(attention.profiles(_attention(spark, at)))


def _attention_scores(spark, at):
    gates = attention.gated(rounded(attention.profiles(_attention(spark, at)), 9), ["accession", "attn_agg"], 0.7)
    joined = gates.join(B.residue_masks(spark, at), ["accession", "pos"])
    return joined.groupBy("annot_type", "attn_agg").agg(F.avg(F.col("on").cast("double")).alias("auprc_mean"))


def harmonic_convergence(spark, at):
    return rounded(attention.convergence(rounded(Q._scores(spark, at)), rounded(_attention_scores(spark, at))))


def layer_quantiles(spark, at):
    return rounded(attention.layer_quantiles(rounded(_attention_scores(spark, at)), "attn_agg", "auprc_mean"))


def pearson_r2(spark, at):
    return rounded(harmonic_convergence(spark, at).agg(r_squared("sae_auprc", "attn_auprc").alias("r2"), F.count_if(F.col("sae_auprc") > F.col("attn_auprc")).alias("sae_wins")))


def stream_running_stats(spark, at):
    return running.replayed(table(spark, at, "events"))


def stream_windows(spark, at):
    """The days that a stream of the events has closed: those that end an hour before the last event."""
    days = running.replayed_windows(table(spark, at, "events"))
    return rounded(days.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "mean", "max"))


QUERIES = {f.__name__: f for f in (
    split_summary_pct, length_stats, length_describe, value_counts, leakage_report, subset_checks, type_by_split_pivot, pivot_row_norm, split_deviation, top_types, top_subtypes_per_type,
    mean_features_per_protein, density_per_100, relative_position_hist, position_ridge, smoothed_tracks, contour_segments, cooccurrence, log_bins_2d, median_trend, char_frequency, prefix_owners, physico_contrast, ablation_contrast, cohen_d, precision_recall,
    self_ablation, triage_quadrants, structural_alignment, convergence_topn, regime_quantile_filter, regime_balanced, regime_gmm, positional_profile, resample_bins, minmax_norm, quantile_gate, moving_average,
    attention_reduce, harmonic_convergence, layer_quantiles, pearson_r2, stream_running_stats, stream_windows,
)}

SPLIT_MEMBERS = f"{SPLIT}, sm AS (SELECT accession, cluster_id, split FROM members JOIN split USING (cluster_id))"
PIVOT = f"""{sql('members', 'ann')}, {SPLIT_MEMBERS}, pv AS (SELECT feature_type, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test
    FROM ann JOIN sm USING (accession) GROUP BY 1)"""
SHARES = f"{PIVOT}, sh AS (SELECT feature_type, train / (train + val + test) AS train, val / (train + val + test) AS val, test / (train + val + test) AS test FROM pv)"
NORMS = "norms AS (SELECT feature_id, sqrt(list_dot_product(w, w)) AS norm FROM w)"
SELF = """sa AS (SELECT accession, feature_id, sum(z) FILTER (z > 0.1) AS hi, count(*) FILTER (z > 0.1) AS n_hi, coalesce(sum(z) FILTER (z <= 0.1), 0) AS lo FROM act GROUP BY ALL HAVING n_hi > 0),
    sc AS (SELECT feature_id, hi / n_hi - coalesce(lo / nullif(length - n_hi, 0), 0) AS contrast FROM sa JOIN len USING (accession)),
    self AS (SELECT feature_id, round(avg(contrast), 6) AS abl_contrast, count(*) AS n FROM sc GROUP BY 1)"""
REGIME = f"""{sql('score')}, rg AS (SELECT feature_id, annot_type, round(auprc_mean, 6) AS auprc_mean, n_clusters, round(tp / (tp + fp + 1e-9), 6) AS precision, round(tp / (n_proteins + 1e-9), 6) AS residues_per_protein,
    CASE WHEN tp / (n_proteins + 1e-9) <= 1.2 THEN 'motif' ELSE 'domain' END AS regime FROM score)"""
ATTENTION = """atn AS (SELECT a.accession, layer, head, a.pos AS query, b.pos AS key, round(abs(list_dot_product(a.x[s:s + 15], b.x[s:s + 15])), 9) AS weight
        FROM res a JOIN res b ON a.accession = b.accession, (SELECT layer, head, 32 * (layer - 1) + 16 * (head - 1) + 1 AS s FROM (VALUES (1), (2)) l(layer), (VALUES (1), (2)) h(head))),
    sent AS (SELECT accession, layer, head, query AS pos, sum(weight) AS w FROM atn GROUP BY ALL),
    recv AS (SELECT accession, layer, head, key AS pos, sum(weight) AS w FROM atn GROUP BY ALL),
    lay AS (SELECT accession, layer, pos, avg(w) AS score FROM sent GROUP BY ALL),
    raw AS (SELECT accession, pos, 'mean_sent' AS attn_agg, avg(w) AS score FROM sent GROUP BY ALL UNION ALL SELECT accession, pos, 'max_sent', max(w) FROM sent GROUP BY ALL
        UNION ALL SELECT accession, pos, 'mean_received', avg(w) FROM recv GROUP BY ALL UNION ALL SELECT accession, pos, 'last_layer_sent', score FROM lay WHERE layer = 2
        UNION ALL SELECT accession, pos, printf('layer_%02d_sent', layer), score FROM lay),
    prof AS (SELECT accession, pos, attn_agg, (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p + 1e-8) AS score FROM raw WINDOW p AS (PARTITION BY accession, attn_agg)),
    prof9 AS (SELECT accession, pos, attn_agg, round(score, 9) AS score FROM prof),
    bars AS (SELECT accession, attn_agg, quantile_cont(score, 0.7) AS bar FROM prof9 GROUP BY ALL),
    ascore AS (SELECT annot_type, attn_agg, round(avg(CASE WHEN score > bar THEN 1.0 ELSE 0 END), 6) AS auprc_mean FROM prof9 JOIN bars USING (accession, attn_agg) JOIN res USING (accession, pos) GROUP BY ALL)"""
CONVERGED = f"""{sql('score')}, {Q.ROUNDED}, {Q.BEST}, {ATTENTION},
    abest AS (SELECT * FROM ascore QUALIFY row_number() OVER (PARTITION BY annot_type ORDER BY auprc_mean DESC, attn_agg) = 1),
    cv AS (SELECT annot_type, attn_agg AS best_attn, abest.auprc_mean AS attn_auprc, feature_id AS best_feature, best.auprc_mean AS sae_auprc,
        round(CASE WHEN best.auprc_mean + abest.auprc_mean > 0 THEN 2 * best.auprc_mean * abest.auprc_mean / (best.auprc_mean + abest.auprc_mean) ELSE 0 END, 6) AS convergence_score FROM abest JOIN best USING (annot_type))"""
_SCALES = ", ".join(f"('{r}', '{p}', {float(v)}::DOUBLE)" for p, values in EVIDENCE.items() for r, v in zip(RESIDUES, values, strict=True))

ORACLE_SQL = {
    "split_summary_pct": f"""{sql('members')}, {SPLIT_MEMBERS}, g AS (SELECT split, count(DISTINCT cluster_id) AS n_clusters, count(*) AS n_members FROM sm GROUP BY 1)
        SELECT split, n_clusters, n_members, round(n_clusters / sum(n_clusters) OVER () * 100, 6) AS pct_clusters, round(n_members / sum(n_members) OVER () * 100, 6) AS pct_members FROM g""",
    "length_stats": f"{sql('proteins')} SELECT lang, count(*) AS n, round(avg(length), 6) AS mean, round(median(length), 6) AS median, round(stddev_samp(length), 6) AS std, min(length) AS min, max(length) AS max FROM proteins GROUP BY 1",
    "length_describe": f"""{sql('proteins')} SELECT count(length) AS n, round(avg(length), 6) AS mean, round(stddev_samp(length), 6) AS std, min(length) AS min, round(quantile_cont(length, 0.25), 6) AS q25,
        round(quantile_cont(length, 0.5), 6) AS q50, round(quantile_cont(length, 0.75), 6) AS q75, max(length) AS max FROM proteins""",
    "value_counts": f"{sql('ann')} SELECT feature_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ann GROUP BY 1",
    "leakage_report": f"""{sql('members', 'ann')}, {SPLIT_MEMBERS}, t AS (SELECT accession, feature_type, start_, end_, count(*) AS n FROM ann GROUP BY ALL)
        SELECT 'clusters_in_several_splits' AS metric, count(*) AS value FROM (SELECT cluster_id FROM sm GROUP BY 1 HAVING count(DISTINCT split) > 1)
        UNION ALL SELECT 'accessions_in_several_splits', count(*) FROM (SELECT accession FROM sm GROUP BY 1 HAVING count(DISTINCT split) > 1)
        UNION ALL SELECT 'repeated_accessions', count(*) - count(DISTINCT accession) FROM sm
        UNION ALL SELECT 'repeated_annotations', CAST(sum(n - 1) AS BIGINT) FROM t
        UNION ALL SELECT 'orphan_annotations', count(*) FROM ann WHERE accession NOT IN (SELECT accession FROM sm)""",
    "subset_checks": "SELECT * FROM (VALUES ('whole_clusters', true), ('unique_accessions', true), ('known_accessions', true), ('no_null_keys', true)) t(\"check\", ok)",
    "type_by_split_pivot": f"{PIVOT} SELECT * FROM pv",
    "pivot_row_norm": f"{SHARES} SELECT feature_type, round(train, 6) AS train, round(val, 6) AS val, round(test, 6) AS test FROM sh",
    "split_deviation": f"""{SHARES} SELECT feature_type, round(train - 0.7, 6) AS dev_train, round(val - 0.15, 6) AS dev_val, round(test - 0.15, 6) AS dev_test,
        round(greatest(abs(train - 0.7), abs(val - 0.15), abs(test - 0.15)), 6) AS max_deviation FROM sh""",
    "top_types": f"{sql('enriched')} SELECT annot_subtype, count(*) AS n FROM enriched GROUP BY 1 ORDER BY n DESC, annot_subtype LIMIT 10",
    "top_subtypes_per_type": f"""{sql('enriched')}, c AS (SELECT feature_type, annot_subtype, count(*) AS n FROM enriched GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY feature_type ORDER BY n DESC, annot_subtype) AS nth FROM c QUALIFY nth <= 5""",
    "mean_features_per_protein": f"{sql('ann')}, p AS (SELECT accession, feature_type, count(*) AS n FROM ann GROUP BY ALL) SELECT feature_type, round(avg(n), 6) AS mean_n, count(*) AS n_accessions FROM p GROUP BY 1",
    "density_per_100": f"{sql('ann', 'lengths')}, p AS (SELECT accession, count(*) AS n FROM ann GROUP BY 1) SELECT accession, round(n / greatest(length, 1) * 100, 6) AS density FROM p JOIN lengths USING (accession)",
    "relative_position_hist": f"""{sql('ann', 'lengths')}, r AS (SELECT feature_type, round((start_ + end_) / 2.0 / length, 9) AS x FROM ann JOIN lengths USING (accession))
        SELECT feature_type, CAST(least(floor(x * 16), 15) AS INT) AS bin, count(*) AS n FROM r WHERE x BETWEEN 0 AND 1 GROUP BY 1, 2""",
    "position_ridge": f"""{sql('ann', 'lengths')}, r AS (SELECT feature_type, (start_ + end_) / 2.0 / length AS x FROM ann JOIN lengths USING (accession)),
        big AS (SELECT feature_type, median(x) AS median FROM r GROUP BY 1 HAVING count(x) >= 5),
        h AS (SELECT feature_type, CAST(least(floor(round(x * 80, 7)), 79) AS INT) AS bin, count(*) AS n FROM r WHERE x BETWEEN 0 AND 1 GROUP BY 1, 2),
        p AS (SELECT feature_type, median, point, point / 199.0 AS x, greatest(least(point / 199.0 * 80 - 0.5, 79.0), 0.0) AS t FROM big, (SELECT unnest(range(0, 200)) AS point)),
        y AS (SELECT p.*, coalesce(a.n, 0) + (coalesce(b.n, 0) - coalesce(a.n, 0)) * (t - floor(t)) AS y FROM p
            LEFT JOIN h a ON a.feature_type = p.feature_type AND a.bin = floor(t) LEFT JOIN h b ON b.feature_type = p.feature_type AND b.bin = least(floor(t) + 1, 79))
        SELECT feature_type, CAST(point AS INT) AS point, round(CAST(x AS DOUBLE), 5) AS x, round(y / max(y) OVER (PARTITION BY feature_type) * 0.85, 5) AS y, round(median, 5) AS median FROM y""",
    "smoothed_tracks": """WITH l AS (SELECT l_suppkey AS supplier, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS INT) AS pos, CAST(l_quantity AS DOUBLE) AS v, count(*) OVER (PARTITION BY l_suppkey) AS length FROM lineitem),
        s AS (SELECT *, greatest(3, length // 50) AS w, sum(v) OVER (PARTITION BY supplier ORDER BY pos) AS upto FROM l),
        m AS (SELECT a.supplier, a.pos, a.length, round((hi.upto - coalesce(lo.upto, 0)) / a.w, 9) AS smooth FROM s a
            JOIN s hi ON hi.supplier = a.supplier AND hi.pos = least(a.pos + (a.w - 1) // 2, a.length) LEFT JOIN s lo ON lo.supplier = a.supplier AND lo.pos = a.pos - a.w // 2 - 1)
        SELECT supplier, pos, length, round(smooth, 5) AS smooth, round((smooth - min(smooth) OVER g) / (max(smooth) OVER g - min(smooth) OVER g + 1e-8), 5) AS score FROM m WINDOW g AS (PARTITION BY supplier)""",
    "contour_segments": f"""{sql('ann', 'lengths')}, k AS (SELECT DISTINCT accession, feature_type AS annot_type, length, unnest(generate_series(greatest(start_, 1), least(end_, length))) AS pos FROM ann JOIN lengths USING (accession)),
        c AS (SELECT accession, length, bin, bin * length // 20 AS lo, greatest((bin + 1) * length // 20, bin * length // 20 + 1) AS hi FROM lengths, (SELECT unnest(range(0, 20)) AS bin)),
        s AS (SELECT accession, annot_type, bin, count(*) / (hi - lo) AS share FROM k JOIN c USING (accession, length) WHERE pos > lo AND pos <= hi GROUP BY accession, annot_type, bin, hi, lo),
        r AS (SELECT *, bin - row_number() OVER (PARTITION BY accession, annot_type ORDER BY bin) AS island FROM s WHERE round(share, 9) > 0.3)
        SELECT accession, annot_type, CAST(min(bin) AS INT) AS first, CAST(max(bin) AS INT) AS last, min(bin) - 0.5::DOUBLE AS x, count(*) AS width FROM r GROUP BY accession, annot_type, island""",
    "regime_gmm": f"""{sql('score').replace('WITH', 'WITH RECURSIVE', 1)}, v AS (SELECT round(ln(1 + tp / (n_proteins + 1e-9)), 3) AS v, CAST(count(*) AS DOUBLE) AS n FROM score GROUP BY 1),
        t AS (SELECT sum(n) AS total, sum(v * n) / sum(n) AS mean, sum(v * v * n) / sum(n) AS square FROM v),
        em AS (SELECT 0 AS step, (SELECT min(v) FROM v) AS m1, (SELECT max(v) FROM v) AS m2, greatest(square - mean * mean, 1e-6) AS s1, greatest(square - mean * mean, 1e-6) AS s2, 0.5::DOUBLE AS p1, 0.5::DOUBLE AS p2 FROM t
            UNION ALL
            SELECT step + 1, m1, m2, greatest(q1 / w1 - m1 * m1, 1e-6), greatest(q2 / w2 - m2 * m2, 1e-6), w1 / total, w2 / total FROM (
                SELECT step, greatest(sum(n * (1 - r)), 1e-12) AS w1, greatest(sum(n * r), 1e-12) AS w2, sum(n * (1 - r) * v) / greatest(sum(n * (1 - r)), 1e-12) AS m1, sum(n * r * v) / greatest(sum(n * r), 1e-12) AS m2,
                    sum(n * (1 - r) * v * v) AS q1, sum(n * r * v * v) AS q2
                FROM (SELECT step, v, n, 1 / (1 + exp(greatest(least((ln(greatest(p1, 1e-12)) - 0.5 * ln(s1) - (v - m1) ** 2 / (2 * s1)) - (ln(greatest(p2, 1e-12)) - 0.5 * ln(s2) - (v - m2) ** 2 / (2 * s2)), 500), -500))) AS r FROM em, v WHERE step < {evidence.MIXTURE_STEPS})
                GROUP BY step), t)
        SELECT round(((exp(m1) - 1) + (exp(m2) - 1)) / 2, 5) AS threshold FROM em WHERE step = {evidence.MIXTURE_STEPS}""",
    "cooccurrence": f"""{sql('ann')}, o AS (SELECT DISTINCT accession, feature_type FROM ann) SELECT a.feature_type AS type_a, b.feature_type AS type_b, count(*) AS n
        FROM o a JOIN o b ON a.accession = b.accession AND a.feature_type <> b.feature_type GROUP BY 1, 2""",
    "log_bins_2d": f"""{sql('ann')}, b AS (SELECT CAST(floor(round(log10(end_ - start_ + 1) / 0.1, 9)) AS INT) AS x_bin, CAST(floor(round(log10(p_retailprice) / 0.1, 9)) AS INT) AS y_bin
        FROM ann JOIN part ON p_partkey = ann.part) SELECT x_bin, y_bin, count(*) AS n FROM b GROUP BY 1, 2""",
    "median_trend": f"{sql('ann')} SELECT start_ AS bin, round(median(end_ - start_ + 1), 6) AS median, count(*) AS n FROM ann GROUP BY 1 HAVING count(*) > 10",
    "char_frequency": f"""{sql('proteins')}, l AS (SELECT unnest(string_split(upper(regexp_replace(sequence, '[^ -~]', '', 'g')), '')) AS letter FROM proteins), c AS (SELECT letter, count(*) AS n FROM l WHERE letter IN ({', '.join(f"'{r}'" for r in RESIDUES)}) GROUP BY 1)
        SELECT letter, n, round(n / sum(n) OVER (), 6) AS share FROM c""",
    "prefix_owners": f"""{sql('score')}, {Q.ROUNDED}, n AS (SELECT (annot_type % 3) || ': ' || annot_type AS annot_type, feature_id, auprc_mean FROM s)
        SELECT annot_type, feature_id, auprc_mean FROM n QUALIFY row_number() OVER (PARTITION BY split_part(annot_type, ':', 1) ORDER BY auprc_mean DESC, annot_type, feature_id) = 1""",
    "physico_contrast": f"""{sql('proteins')}, p AS (SELECT upper(regexp_replace(sequence, '[^ -~]', '', 'g')) AS s FROM proteins), c AS (SELECT unnest(string_split(s, '')) AS residue, unnest(generate_series(1, length(s))) AS pos FROM p WHERE s <> ''),
        l AS (SELECT residue, pos % 5 = 0 AS inside FROM c WHERE contains('{RESIDUES}X', residue) AND residue <> ''),
        scale(residue, property, value) AS (VALUES {_SCALES}), props AS (SELECT DISTINCT property FROM scale),
        k AS (SELECT residue, inside, count(*) AS n FROM l GROUP BY ALL), e AS (SELECT l.*, property, value FROM (l CROSS JOIN props) LEFT JOIN scale USING (residue, property)),
        g AS (SELECT property, avg(value) FILTER (inside) AS mean_in, avg(value) FILTER (NOT inside) AS mean_out, stddev_pop(value) FILTER (inside) AS si, stddev_pop(value) FILTER (NOT inside) AS so,
            count(*) FILTER (inside) AS n_in, count(*) FILTER (NOT inside) AS n_out FROM e GROUP BY 1)
        SELECT property, round(mean_in, 6) AS mean_in, round(mean_out, 6) AS mean_out, n_in, n_out, round(mean_in - mean_out, 6) AS contrast,
            round(CASE WHEN si * si + so * so > 0 THEN (mean_in - mean_out) / sqrt((si * si + so * so) / 2) ELSE 0 END, 6) AS cohen_d FROM g""",
    "ablation_contrast": f"""{sql('dense')}, {NORMS}, v AS (SELECT accession, feature_id, annot_type = 3 AS inside, z * norm AS d FROM dense JOIN norms USING (feature_id)),
        p AS (SELECT accession, feature_id, round(coalesce(avg(d) FILTER (inside), 0) - coalesce(avg(d) FILTER (NOT inside), 0), 9) AS contrast, count(*) FILTER (inside) AS n_in FROM v GROUP BY ALL HAVING n_in > 0)
        SELECT feature_id, round(avg(contrast), 6) AS mean_contrast, round(median(contrast), 6) AS median_contrast, round(avg(CASE WHEN contrast > 0 THEN 1.0 ELSE 0 END), 6) AS frac_positive, count(*) AS n_proteins FROM p GROUP BY 1""",
    "cohen_d": f"""{sql('dense')}, g AS (SELECT feature_id, avg(z) FILTER (annot_type = 3) AS mi, avg(z) FILTER (annot_type <> 3) AS mo, stddev_pop(z) FILTER (annot_type = 3) AS si, stddev_pop(z) FILTER (annot_type <> 3) AS so,
            count(*) FILTER (annot_type = 3) AS n_in FROM dense GROUP BY 1)
        SELECT feature_id, round(mi, 6) AS mean_in, round(mo, 6) AS mean_out, round(CASE WHEN si * si + so * so > 0 THEN (mi - mo) / sqrt((si * si + so * so) / 2) ELSE 0 END, 6) AS cohen_d, n_in FROM g""",
    "precision_recall": f"""{sql('dense')}, g AS (SELECT feature_id, count(*) FILTER (z > 0.1 AND annot_type = 3) AS h, count(*) FILTER (z > 0.1) AS o, count(*) FILTER (annot_type = 3) AS i FROM dense GROUP BY 1)
        SELECT feature_id, round(h / greatest(o, 1), 6) AS precision, round(h / greatest(i, 1), 6) AS recall FROM g""",
    "self_ablation": f"{sql('act', 'len')}, {SELF} SELECT * FROM self",
    "triage_quadrants": f"""{Q.TRIAGE}, {SELF} SELECT feature_id, best_auprc, abl_contrast, CASE WHEN best_auprc < 0.6 AND abl_contrast > 0.25 THEN 'novel' WHEN best_auprc >= 0.6 AND abl_contrast > 0.25 THEN 'known'
        WHEN best_auprc >= 0.6 THEN 'correlated' ELSE 'silent' END AS quadrant FROM triage LEFT JOIN self USING (feature_id)""",
    "structural_alignment": f"""{sql('res', 'w')}, d AS (SELECT accession, pos, annot_type, unnest(range(1, len(x) + 1)) AS dim, unnest(x) AS v FROM res), t AS (SELECT dim, sum(v) AS s, count(*) AS n FROM d GROUP BY 1),
        i AS (SELECT annot_type, dim, sum(v) AS si, count(*) AS ni FROM d GROUP BY ALL), r AS (SELECT annot_type, dim, si / ni - (s - si) / (n - ni) AS d FROM i JOIN t USING (dim) WHERE n > ni),
        e AS (SELECT feature_id, unnest(range(1, len(w) + 1)) AS dim, unnest(w) AS w FROM w)
        SELECT annot_type, feature_id, round(sum(d * w) / (sqrt(sum(d * d)) * sqrt(sum(w * w))), 6) AS cosine FROM r JOIN e USING (dim) GROUP BY 1, 2""",
    "convergence_topn": f"""{sql('score')}, {Q.ROUNDED}, {Q.BEST} SELECT best.feature_id AS focal_id, annot_type, s.feature_id, s.auprc_mean,
            CAST(row_number() OVER (PARTITION BY annot_type ORDER BY s.auprc_mean DESC, s.feature_id) AS INT) AS nth
        FROM best JOIN s USING (annot_type) WHERE s.feature_id <> best.feature_id QUALIFY nth <= 3""",
    "regime_quantile_filter": f"""{REGIME}, b AS (SELECT regime, quantile_cont(precision, 0.1) AS bar FROM rg GROUP BY 1)
        SELECT feature_id, annot_type, precision, residues_per_protein, regime FROM rg JOIN b USING (regime) WHERE precision >= bar AND n_clusters >= CASE regime WHEN 'domain' THEN 3 ELSE 2 END""",
    "regime_balanced": f"""{REGIME} SELECT regime, feature_id, annot_type, auprc_mean, CAST(row_number() OVER (PARTITION BY regime ORDER BY auprc_mean DESC, feature_id, annot_type) AS INT) AS nth FROM rg QUALIFY nth <= 5""",
    "positional_profile": f"""{sql('dense', 'len')}, b AS (SELECT feature_id, z, CAST(floor(round((pos - 1) / greatest(length - 1, 1) * 6, 9)) AS INT) AS bin FROM dense JOIN len USING (accession))
        SELECT feature_id, bin, round(avg(z), 6) AS mean_z, round(stddev_pop(z), 6) AS sd_z, count(*) AS n FROM b WHERE bin < 6 GROUP BY 1, 2""",
    "resample_bins": f"""{sql('dense', 'len')}, k AS (SELECT accession, bin, bin * length // 7 AS lo, greatest((bin + 1) * length // 7, bin * length // 7 + 1) AS hi FROM len, (SELECT unnest(range(0, 7)) AS bin))
        SELECT accession, feature_id, CAST(bin AS INT) AS bin, round(avg(z), 6) AS z FROM k JOIN dense USING (accession) WHERE pos - 1 >= lo AND pos - 1 < hi GROUP BY 1, 2, 3""",
    "minmax_norm": "SELECT event_id, round((value - min(value) OVER p) / (max(value) OVER p - min(value) OVER p + 1e-8), 6) AS score FROM events WINDOW p AS (PARTITION BY event_type)",
    "quantile_gate": """SELECT event_id, CAST(value > bar AS INT) AS "on" FROM events JOIN (SELECT event_type, quantile_cont(value, 0.9) AS bar FROM events GROUP BY 1) USING (event_type)""",
    "moving_average": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM events",
    "attention_reduce": f"{sql('res')}, {ATTENTION} SELECT accession, pos, attn_agg, round(score, 6) AS score FROM prof",
    "harmonic_convergence": f"{CONVERGED} SELECT * FROM cv",
    "layer_quantiles": f"""{sql('res')}, {ATTENTION} SELECT attn_agg, round(quantile_cont(auprc_mean, 0.25), 6) AS q25, round(quantile_cont(auprc_mean, 0.5), 6) AS median, round(quantile_cont(auprc_mean, 0.75), 6) AS q75 FROM ascore GROUP BY 1""",
    "pearson_r2": f"{CONVERGED} SELECT round(corr(sae_auprc, attn_auprc) ** 2, 6) AS r2, count(*) FILTER (sae_auprc > attn_auprc) AS sae_wins FROM cv",
    "stream_windows": """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS max FROM events
        WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2""",
    "stream_running_stats": """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(greatest(avg(value * value) - avg(value) * avg(value), 0), 6) AS variance, round(max(value), 6) AS max,
        round(avg(CASE WHEN value > 0 THEN 1.0 ELSE 0 END), 6) AS nonzero FROM events GROUP BY 1""",
}
