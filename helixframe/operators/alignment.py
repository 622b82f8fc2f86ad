"""Scoring latent features against annotation types.

Activations are sparse, positions without one are zeros, and every count that
needs them follows from the lengths: true negatives are L - positives - false
positives, and the zeros of a ranking are one block at its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.columns import mystery
from helixframe.functions.metrics import expected_overlap, fisher_greater, geometric_mean, odds_ratio, truncated_odds_ratio
from helixframe.operators.intervals import covering


def confusion(active: DataFrame, masks: DataFrame, lengths: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Per (accession, feature, type) that overlap: tp, fp, fn, tn, n_active, n_pos, length, enrichment.

    ``masks`` has positions (pos), or intervals (a, b) of a type apart from each other,
    which are joined by bins and never laid out by position.  ``lengths`` has
    accession, length and what else is to be carried along.
    """
    on = active.filter(F.col("z") > threshold)
    n_active = on.groupBy("accession", "feature_id").agg(F.count("*").alias("n_active"))
    n_pos = masks.groupBy("accession", "annot_type").agg((F.sum(F.col("b") - F.col("a") + 1) if "a" in masks.columns else F.count("*")).alias("n_pos"))
    met = covering(on, masks, ["accession"]) if "a" in masks.columns else on.join(masks, ["accession", "pos"])
    hits = met.groupBy("accession", "feature_id", "annot_type").agg(F.count("*").alias("tp"))
    joined = hits.join(n_active, ["accession", "feature_id"]).join(n_pos, ["accession", "annot_type"]).join(lengths, "accession")
    counted = joined.withColumns({"fp": F.col("n_active") - F.col("tp"), "fn": F.col("n_pos") - F.col("tp")}).withColumn("tn", F.col("length") - F.col("n_pos") - F.col("fp"))
    expected = expected_overlap(F.col("n_active"), F.col("n_pos"), F.col("tp"), F.col("length"))
    return counted.withColumns({
        "odds_ratio": odds_ratio(*(F.col(c) for c in ("tp", "fp", "fn", "tn"))),
        "expected": expected,
        "enrichment": F.col("tp") / F.nullif(expected, F.lit(0.0)),
    })


def _ranked(pairs: DataFrame, active: DataFrame, masks: DataFrame) -> DataFrame:
    """The activations of each pair's feature with y, whether the pair's type covers the position."""
    rows = pairs.select("accession", "feature_id", "annot_type", "n_pos", "length").join(active, ["accession", "feature_id"])
    if "a" in masks.columns:
        return covering(rows, masks, ["accession", "annot_type"], "left").withColumn("y", F.col("a").isNotNull().cast("int")).drop("a", "b")
    marks = masks.withColumn("y", F.lit(1))
    return rows.join(marks, ["accession", "annot_type", "pos"], "left").withColumn("y", F.coalesce("y", F.lit(0)))


PAIR = ["accession", "feature_id", "annot_type"]


def ap_ties(pairs: DataFrame, active: DataFrame, masks: DataFrame) -> DataFrame:
    """Average precision of each pair with equal activations as one threshold: PAIR, ap."""
    ranked = _ranked(pairs, active, masks)
    down = Window.partitionBy(*PAIR).orderBy(F.desc("z")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    scored = ranked.withColumn("precision", F.sum("y").over(down) / F.count("*").over(down))
    sums = scored.groupBy(*PAIR).agg(F.sum(F.col("y") * F.col("precision")).alias("s"), F.sum("y").alias("found"), F.first("n_pos").alias("n_pos"), F.first("length").alias("length"))
    rest = (F.col("n_pos") - F.col("found")) * F.col("n_pos") / F.col("length")  # positives among the zeros, all at the last threshold
    return sums.select(*PAIR, ((F.col("s") + rest) / F.col("n_pos")).alias("ap"))


def ap_rows(pairs: DataFrame, active: DataFrame, masks: DataFrame) -> DataFrame:
    """Average precision of each pair with every position a threshold of its own, ties by position: PAIR, ap.

    Positions without activation come last, in order.  Only positives among them
    matter, and how many come before one follows from its position less the
    activations up to it.
    """
    ranked = _ranked(pairs, active, masks).withColumn("on", F.lit(1))
    if "a" in masks.columns:  # the pairs' own positives, one by one
        masks = masks.join(pairs.select("accession", "annot_type").distinct(), ["accession", "annot_type"], "left_semi").select("accession", "annot_type", F.explode(F.sequence("a", "b")).alias("pos"))
    unseen = pairs.select(*PAIR, "n_pos", "length").join(masks, ["accession", "annot_type"]).join(active.select("accession", "feature_id", "pos"), ["accession", "feature_id", "pos"], "left_anti")
    rows = ranked.unionByName(unseen.withColumns({"z": F.lit(0.0), "y": F.lit(1), "on": F.lit(0)}))
    down = Window.partitionBy(*PAIR).orderBy(F.desc("z"), "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    along = Window.partitionBy(*PAIR).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(*PAIR)
    found = F.sum(F.col("y") * F.col("on")).over(every) + F.sum(1 - F.col("on")).over(along)
    seen = F.sum("on").over(every) + F.col("pos") - F.sum("on").over(along)
    scored = rows.withColumn("precision", F.when(F.col("on") == 1, F.sum("y").over(down) / F.count("*").over(down)).otherwise(found / seen))
    return scored.groupBy(*PAIR).agg((F.sum(F.col("y") * F.col("precision")) / F.first("n_pos")).alias("ap"))


def records(active: DataFrame, masks: DataFrame, lengths: DataFrame, threshold: float = 0.1, least_odds: float = 1.5, least_ap: float = 0.05, ties: bool = True) -> DataFrame:
    """Scored pairs of each protein; average precision is worked out only where the odds ratio is large enough."""
    pairs = confusion(active, masks, lengths, threshold).filter(F.col("odds_ratio") >= least_odds)
    scores = (ap_ties if ties else ap_rows)(pairs, active, masks)
    return pairs.join(scores, PAIR).filter(F.col("ap") >= least_ap)


COUNTS = ("tp", "fp", "fn", "tn")
_STATE = ["feature_id", "annot_type", "cluster_id"]


def cluster_states(scored: DataFrame) -> DataFrame:
    """Sums for each (feature, type, cluster) that merge by adding: s_ap, s_enrichment, n_enrichment, s_tp, s_fp, s_fn, s_tn, n."""
    return scored.groupBy(*_STATE).agg(
        F.sum("ap").alias("s_ap"), F.sum("enrichment").alias("s_enrichment"), F.count("enrichment").alias("n_enrichment"), *[F.sum(c).alias(f"s_{c}") for c in COUNTS], F.count("*").alias("n")
    )


def merged_states(states: DataFrame) -> DataFrame:
    return states.groupBy(*_STATE).agg(*[F.sum(c).alias(c) for c in states.columns if c not in _STATE])


def scores_of(states: DataFrame) -> DataFrame:
    """Scores of each (feature, type) from one state for each cluster.

    The median and the geometric mean are over means of clusters, so they need no
    state of their own: the sums of a cluster that several drains hold add up first.
    """
    mean = lambda c, n="n": F.col(f"s_{c}") / F.col(n)
    enrichment = F.when(F.col("n_enrichment") > 0, F.col("s_enrichment") / F.nullif("n_enrichment", F.lit(0)))
    per = states.select("feature_id", "annot_type", mean("ap").alias("ap"), enrichment.alias("enrichment"), *[mean(c).alias(c) for c in COUNTS], "n")
    out = per.groupBy("feature_id", "annot_type").agg(
        F.avg("ap").alias("auprc_mean"), F.median("ap").alias("auprc_median"), geometric_mean(F.col("enrichment")).alias("enrichment_gmean"),
        *[F.sum(c).alias(c) for c in COUNTS], F.sum("n").alias("n_proteins"), F.count("*").alias("n_clusters"),
    )
    table = [F.round(F.col(c), 6) for c in COUNTS]  # before cutting, so that the order of sums doesn't matter
    return out.withColumns({"odds_ratio": truncated_odds_ratio(*table), "fisher_p": fisher_greater(*table)})


def by_cluster(scored: DataFrame) -> DataFrame:
    """Scores of each (feature, type): means within clusters first, then over clusters, counts summed over clusters.

    Fisher's p and the odds ratio are those of the counts cut to whole numbers.
    """
    return scores_of(cluster_states(scored))


def constant_enrichment(scored: DataFrame) -> DataFrame:
    """``scored`` with an enrichment of 1, as where a stream works out none."""
    return scored.withColumn("enrichment", F.lit(1.0))


def unweighted(scored: DataFrame, score: str = "ap", by: tuple[str, ...] = ("annot_type",)) -> DataFrame:
    """Scores over proteins without clusters: means, medians, and counts summed."""
    counts = ("tp", "fp", "fn", "tn")
    out = scored.groupBy(*by).agg(F.avg(score).alias("auprc_mean"), F.median(score).alias("auprc_median"), *[F.sum(c).alias(c) for c in counts], F.count("*").alias("n_proteins"))
    return out.withColumns({"odds_ratio": truncated_odds_ratio(*(F.col(c) for c in counts)), "fisher_p": fisher_greater(*(F.col(c) for c in counts))})


def best_of(scores: DataFrame, by: str, score: str = "auprc_mean", tie: str = "feature_id") -> DataFrame:
    """The row of the highest score of each ``by``; missing scores come last, ties go by ``tie``."""
    order = Window.partitionBy(by).orderBy(F.desc_nulls_last(F.when(~F.isnan(score), F.col(score))), tie)
    return scores.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")


def robust(scores: DataFrame, least_proteins: int = 100, most_p: float = 0.01, least_clusters: int | None = 30) -> DataFrame:
    kept = scores.filter((F.col("n_proteins") >= least_proteins) & (F.col("fisher_p") < most_p))
    return kept if least_clusters is None else kept.filter(F.col("n_clusters") >= least_clusters)


def triage(scores: DataFrame, cuts: tuple[float, float] = (0.3, 0.5)) -> DataFrame:
    """Per feature: the best type and score, types above the cuts, the largest finite odds ratio, and 1 - best as mystery."""
    best = best_of(scores, "feature_id", tie="annot_type").select("feature_id", F.col("annot_type").alias("best_annot"), F.col("auprc_mean").alias("best_auprc"))
    finite = F.when(F.abs("odds_ratio") != float("inf"), F.col("odds_ratio"))
    counts = scores.groupBy("feature_id").agg(
        F.count("*").alias("n_types"), F.count_if(F.col("auprc_mean") > cuts[0]).alias("n_above_low"), F.count_if(F.col("auprc_mean") > cuts[1]).alias("n_above_high"), F.max(finite).alias("max_odds_ratio")
    )
    return best.join(counts, "feature_id").withColumn("mystery", mystery(F.col("best_auprc")))


def novel(triaged: DataFrame, threshold: float = 0.25) -> DataFrame:
    return triaged.filter(F.col("best_auprc") < threshold)


def threshold_tally(triaged: DataFrame, cuts: list[float], column: str = "best_auprc") -> DataFrame:
    """How many and what share of the rows lie below each cut."""
    cut = F.explode(F.array(*[F.lit(float(c)) for c in cuts])).alias("cut")
    marked = triaged.select(column, cut)
    return marked.groupBy("cut").agg(F.count_if(F.col(column) < F.col("cut")).alias("n_below"), F.avg((F.col(column) < F.col("cut")).cast("double")).alias("share_below"))


def select_and_evaluate(val: DataFrame, test: DataFrame) -> DataFrame:
    """The best feature of each type on val, with that very pair's scores on test."""
    chosen = best_of(val, "annot_type").select("annot_type", "feature_id", F.col("auprc_mean").alias("val_auprc"))
    frozen = test.select("annot_type", "feature_id", F.col("auprc_mean").alias("test_auprc"), F.col("n_proteins").alias("test_proteins"))
    return chosen.join(frozen, ["annot_type", "feature_id"], "left")


def selection_bias(chosen: DataFrame, test: DataFrame, high: float = 0.8) -> DataFrame:
    """One row: how far the scores chosen on val fall on test, and how a choice on test itself would look."""
    naive = best_of(test, "annot_type").select("annot_type", F.col("auprc_mean").alias("naive"))
    return chosen.join(naive, "annot_type", "left").agg(
        F.count("*").alias("n_types"), F.count("test_auprc").alias("n_evaluated"), F.avg("val_auprc").alias("val_mean"), F.avg("test_auprc").alias("test_mean"),
        F.avg(F.col("val_auprc") - F.col("test_auprc")).alias("gap"), F.avg("naive").alias("naive_mean"), F.avg(F.col("naive") - F.col("test_auprc")).alias("naive_gap"),
        F.count_if(F.col("val_auprc") >= high).alias("n_high_val"), F.count_if(F.col("test_auprc") >= high).alias("n_high_test"),
    )
