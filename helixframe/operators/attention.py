"""Attention profiles as a baseline: reductions, gates, convergence with latent features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.columns import harmonic, min_max
from helixframe.operators.alignment import best_of
from helixframe.operators.quantiles import quantiles


def profiles(attention: DataFrame) -> DataFrame:
    """accession, pos, attn_agg, score from accession, layer, head, query, key, weight; layers and positions from 1.

    ``sent`` sums a query's weights over keys and ``received`` a key's over
    queries.  Aggregates: their means over layers and heads, the largest sent, the
    last layer's mean, and each layer's mean; each scaled to 0..1 in the protein.
    The weights are read once; rows dealt out by accession stay where they are.
    """
    sides = F.inline(F.array(F.struct(F.col("query").alias("pos"), F.lit(True).alias("sent")), F.struct(F.col("key").alias("pos"), F.lit(False).alias("sent"))))
    sums = attention.select("accession", "layer", "head", sides, "weight").groupBy("accession", "layer", "head", "pos", "sent").agg(F.sum("weight").alias("w"))
    named = lambda c: F.struct(c.alias("attn_agg"))
    own_layer = F.format_string("layer_%02d_sent", "layer")
    sent = F.array(*[named(c) for c in (F.lit("mean_sent"), F.lit("max_sent"), own_layer)])
    last = F.when(F.col("layer") == F.max("layer").over(Window.partitionBy("accession")), F.array(named(F.lit("last_layer_sent")))).otherwise(F.array().cast("array<struct<attn_agg:string>>"))
    dealt = sums.withColumn("last", last).select("accession", "pos", "w", F.inline(F.when(F.col("sent"), F.concat(sent, "last")).otherwise(F.array(named(F.lit("mean_received"))))))
    both = dealt.groupBy("accession", "pos", "attn_agg").agg(F.avg("w").alias("mean"), F.max("w").alias("most"))
    out = both.select("accession", "pos", "attn_agg", F.when(F.col("attn_agg") == "max_sent", F.col("most")).otherwise(F.col("mean")).alias("score"))
    return out.withColumn("score", min_max(F.col("score"), Window.partitionBy("accession", "attn_agg")))


def gated(scores: DataFrame, keys: list[str], quantile: float = 0.9, value: str = "score") -> DataFrame:
    """``scores`` with on, whether the value is above the quantile of its group."""
    bars = quantiles(scores, keys, value, [quantile]).withColumn("bar", F.get("q", F.lit(0))).drop("q")
    return scores.join(bars, keys).withColumn("on", (F.col(value) > F.col("bar")).cast("int"))


def convergence(latent: DataFrame, attention: DataFrame) -> DataFrame:
    """Per type the best latent feature beside the best attention aggregate, and their harmonic mean."""
    sae = best_of(latent, "annot_type").select("annot_type", F.col("feature_id").alias("best_feature"), F.col("auprc_mean").alias("sae_auprc"))
    attn = best_of(attention, "annot_type", tie="attn_agg").select("annot_type", F.col("attn_agg").alias("best_attn"), F.col("auprc_mean").alias("attn_auprc"))
    return attn.join(sae, "annot_type").withColumn("convergence_score", harmonic(F.col("sae_auprc"), F.col("attn_auprc")))


def layer_quantiles(scores: DataFrame, layer: str = "layer", value: str = "auprc") -> DataFrame:
    return quantiles(scores, [layer], value, [0.25, 0.5, 0.75]).select(layer, F.get("q", F.lit(0)).alias("q25"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q75"))


def varied(profile: DataFrame, n: int = 8, least_range: float = 0.08, least_peak: float = 0.1) -> DataFrame:
    """The ``n`` types whose layer profile varies most; if none varies enough, those of the largest range."""
    spans = profile.groupBy("annot_type").agg((F.max("auprc") - F.min("auprc")).alias("range"), F.max("auprc").alias("peak"))
    some = spans.withColumn("enough", ((F.col("range") > least_range) & (F.col("peak") > least_peak)).cast("int")).withColumn("any", F.max("enough").over(Window.partitionBy()))
    return some.filter("enough = any").orderBy(F.desc("range"), "annot_type").limit(n).select("annot_type", "range", "peak")


def spread_peaks(profile: DataFrame, n: int = 3, apart: int = 3) -> list[str]:
    """Up to ``n`` types whose peak layers lie ``apart``, best first, then the best of the rest.

    Of types that peak in one layer only the best can be chosen for being apart, so
    a row for each layer and the best rows of all decide.
    """
    order = Window.partitionBy("annot_type").orderBy(F.desc("auprc"), "layer")
    peaks = profile.withColumn("nth", F.row_number().over(order)).filter("nth = 1")
    of_layer = Window.partitionBy("layer").orderBy(F.desc("auprc"), "annot_type")
    some = peaks.withColumn("nth", F.row_number().over(of_layer)).filter("nth = 1").unionByName(peaks.orderBy(F.desc("auprc"), "annot_type").limit(2 * n))
    peaks = some.drop("nth").distinct().orderBy(F.desc("auprc"), "annot_type").collect()
    chosen: list = []
    for r in peaks:
        if len(chosen) < n and all(abs(r["layer"] - c["layer"]) >= apart for c in chosen):
            chosen.append(r)
    rest = [r for r in peaks if r not in chosen]
    return [r["annot_type"] for r in [*chosen, *rest][:n]]
