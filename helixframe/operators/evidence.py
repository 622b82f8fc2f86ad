"""Evidence that a latent feature and an annotation belong together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.columns import per_protein, precision
from helixframe.functions.metrics import cohen_d
from helixframe.operators.batching import numbered
from helixframe.operators.intervals import covering
from helixframe.operators.quantiles import quantiles
from helixframe.plans.staging import staged


def letters(sequences: DataFrame, key: str = "accession", sequence: str = "sequence") -> DataFrame:
    """key, pos (from 1), residue (upper case)."""
    return sequences.select(key, F.posexplode(F.split(F.upper(sequence), "")).alias("pos", "residue")).filter("residue != ''").withColumn("pos", F.col("pos") + 1)


def physico_contrast(residues: DataFrame, scales: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per property the means inside and outside of a mask and Cohen's d.

    ``residues`` has residue and inside (0 or 1), and n where rows were counted
    before; ``scales`` is a small table.
    Residues without a value count in n_in and n_out but in no mean.
    """
    properties = scales.select("property").distinct()
    # Counted first: a few dozen rows are left, whatever the number of residues.
    counts = residues.groupBy(*(by or []), "residue", "inside").agg((F.sum("n") if "n" in residues.columns else F.count("*")).alias("n"))
    joined = counts.join(F.broadcast(properties)).join(F.broadcast(scales), ["residue", "property"], "left")

    def moments(side: int, name: str) -> list[Column]:
        here = F.col("inside") == side
        known = F.sum(F.when(here & F.col("value").isNotNull(), F.col("n")))
        mean = F.sum(F.when(here, F.col("n") * F.col("value"))) / known
        square = F.sum(F.when(here, F.col("n") * F.col("value") * F.col("value"))) / known
        return [mean.alias(f"mean_{name}"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias(f"sd_{name}"), F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0)).alias(f"n_{name}")]

    grouped = joined.groupBy(*(by or []), "property").agg(*moments(1, "in"), *moments(0, "out"))
    d = cohen_d(F.col("mean_in"), F.col("sd_in"), F.col("mean_out"), F.col("sd_out"))
    return grouped.withColumns({"contrast": F.col("mean_in") - F.col("mean_out"), "cohen_d": d}).drop("sd_in", "sd_out")


def feature_letters(active: DataFrame, letters_: DataFrame, features: DataFrame, threshold: float = 0.1) -> DataFrame:
    """feature_id, residue, inside, n: how often each letter stands where a feature is over the threshold, and elsewhere.

    Elsewhere is all less inside, so no position is repeated for the features that are silent there.
    """
    on = active.filter(F.col("z") > threshold).join(letters_, ["accession", "pos"]).groupBy("feature_id", "residue").agg(F.count("*").alias("on"))
    whole = letters_.groupBy("residue").agg(F.count("*").alias("all"))  # an alphabet
    grid = features.select("feature_id").join(F.broadcast(whole)).join(on, ["feature_id", "residue"], "left").withColumn("on", F.coalesce("on", F.lit(0)))
    sides = F.explode(F.array(F.struct(F.lit(1).alias("inside"), F.col("on").alias("n")), F.struct(F.lit(0).alias("inside"), (F.col("all") - F.col("on")).alias("n"))))
    return grid.select("feature_id", "residue", sides.alias("s")).select("feature_id", "residue", "s.inside", "s.n").filter("n > 0")


def case_tracks(active: DataFrame, annotations: DataFrame, letters_: DataFrame, cases: DataFrame) -> DataFrame:
    """Every position of the proteins of ``cases`` (feature_id, accession): pos, residue, z, z of the protein's largest, annotated (0 or 1), bold (C and H)."""
    rows = cases.select("feature_id", "accession").join(letters_, "accession").join(active, ["feature_id", "accession", "pos"], "left").withColumn("z", F.coalesce("z", F.lit(0.0)))
    top = rows.groupBy("feature_id", "accession").agg(F.greatest(F.max("z"), F.lit(1e-8)).alias("top"))
    seen = covering(rows.join(top, ["feature_id", "accession"]), annotations.select("accession", "a", "b"), ["accession"], "left")
    return seen.select("feature_id", "accession", "pos", "residue", "z", (F.col("z") / F.col("top")).alias("shade"), F.col("a").isNotNull().cast("int").alias("annotated"), F.col("residue").isin("C", "H").alias("bold"))


def marked(active: DataFrame, intervals: DataFrame) -> DataFrame:
    """``active`` with inside, whether one of the accession's intervals (a, b; apart from each other) covers the position."""
    inside = covering(active, intervals, ["accession"], "left")
    return inside.withColumn("inside", F.col("a").isNotNull().cast("int")).drop("a", "b")


def mask_sizes(intervals: DataFrame, lengths: DataFrame) -> DataFrame:
    """accession, n_in, n_out: how many positions lie inside the intervals and outside."""
    covered = intervals.groupBy("accession").agg(F.sum(F.col("b") - F.col("a") + 1).alias("n_in"))
    joined = lengths.select("accession", "length").join(covered, "accession", "left").withColumn("n_in", F.coalesce("n_in", F.lit(0)))
    return joined.select("accession", "n_in", (F.col("length") - F.col("n_in")).alias("n_out"))


def _mean(total: Column, n: Column) -> Column:
    return F.coalesce(total / F.nullif(n.cast("double"), F.lit(0.0)), F.lit(0.0))


def sparse_contrast(active: DataFrame, intervals: DataFrame, lengths: DataFrame, features: DataFrame) -> DataFrame:
    """Per feature over all positions: mean_in, mean_out, contrast, cohen_d, n_in, length, positions without activation as zeros.

    The sums are of activations alone; the zeros follow from the sizes of the masks.
    """
    sums = marked(active, intervals).groupBy("feature_id").agg(*[F.sum(F.when(F.col("inside") == i, v)).alias(f"{n}_{side}") for i, side in ((1, "in"), (0, "out")) for n, v in (("s", F.col("z")), ("ss", F.col("z") * F.col("z")))])
    total = mask_sizes(intervals, lengths).agg(F.coalesce(F.sum("n_in"), F.lit(0)).alias("n_in"), F.coalesce(F.sum("n_out"), F.lit(0)).alias("n_out"))
    rows = features.select("feature_id").join(sums, "feature_id", "left").na.fill(0.0).join(F.broadcast(total))  # one row of totals
    for side in ("in", "out"):
        mean = _mean(F.col(f"s_{side}"), F.col(f"n_{side}"))
        rows = rows.withColumn(f"mean_{side}", mean).withColumn(f"sd_{side}", F.sqrt(F.greatest(_mean(F.col(f"ss_{side}"), F.col(f"n_{side}")) - mean * mean, F.lit(0.0))))
    d = cohen_d(F.col("mean_in"), F.col("sd_in"), F.col("mean_out"), F.col("sd_out"))
    return rows.select("feature_id", "mean_in", "mean_out", (F.col("mean_in") - F.col("mean_out")).alias("contrast"), d.alias("cohen_d"), "n_in", (F.col("n_in") + F.col("n_out")).alias("length"))


def sparse_precision_recall(active: DataFrame, intervals: DataFrame, lengths: DataFrame, features: DataFrame, threshold: float) -> DataFrame:
    """feature_id, precision, recall over all positions; empty denominators count as one."""
    on = marked(active.filter(F.col("z") > threshold), intervals)
    counts = on.groupBy("feature_id").agg(F.count("*").alias("on"), F.sum("inside").alias("hits"))
    total = mask_sizes(intervals, lengths).agg(F.coalesce(F.sum("n_in"), F.lit(0)).alias("n_in"))
    rows = features.select("feature_id").join(counts, "feature_id", "left").na.fill(0).join(F.broadcast(total))
    return rows.select("feature_id", (F.col("hits") / F.greatest("on", F.lit(1))).alias("precision"), (F.col("hits") / F.greatest("n_in", F.lit(1))).alias("recall"))


def best_contrasts(active: DataFrame, intervals: DataFrame, lengths: DataFrame, features: DataFrame, digits: int = 6) -> DataFrame:
    """feature_id, accession, contrast: of each feature the protein with a mask whose mean activation inside exceeds that outside most, ties by accession.

    A protein in which the feature is silent has contrast 0.  Of these only the first
    can be best; it is the first number that the others leave out when proteins are
    numbered by accession.
    """
    sizes = staged(numbered(mask_sizes(intervals, lengths).filter("n_in > 0"), [], [F.col("accession")]).withColumnRenamed("nth", "place"))
    sums = marked(active, intervals).groupBy("accession", "feature_id").agg(*[F.coalesce(F.sum(F.when(F.col("inside") == i, F.col("z"))), F.lit(0.0)).alias(f"s_{side}") for i, side in ((1, "in"), (0, "out"))])
    contrast = F.round(_mean(F.col("s_in"), F.col("n_in")) - _mean(F.col("s_out"), F.col("n_out")), digits)
    heard = sums.join(sizes, "accession").select("feature_id", "accession", contrast.alias("contrast"), "place")
    gaps = numbered(heard.select("feature_id", "place"), ["feature_id"], [F.col("place")]).groupBy("feature_id").agg(F.min(F.when(F.col("place") > F.col("nth"), F.col("nth"))).alias("gap"), F.count("*").alias("n"))
    first = features.select("feature_id").join(gaps, "feature_id", "left").select("feature_id", F.coalesce("gap", "n", F.lit(0)).alias("place"))
    silent = first.join(sizes, "place").select("feature_id", "accession", F.lit(0.0).alias("contrast"))
    rows = heard.select("feature_id", "accession", "contrast").unionByName(silent)
    order = Window.partitionBy("feature_id").orderBy(F.desc("contrast"), "accession")
    return rows.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")


def ablation_summary(active: DataFrame, intervals: DataFrame, lengths: DataFrame, decoder_norms: DataFrame, digits: int = 9) -> DataFrame:
    """Per feature over the proteins with a mask: mean_contrast, median_contrast, frac_positive, n_proteins.

    A protein's contrast is the mean shift of its decoding inside the mask less that
    outside when the feature is left out: its activations times the norm of the
    decoder's row.  A protein in which a feature is silent has contrast 0; how many
    these are follows from the number of proteins.
    """
    sizes = mask_sizes(intervals, lengths).filter("n_in > 0")
    sums = marked(active, intervals).groupBy("accession", "feature_id").agg(*[F.coalesce(F.sum(F.when(F.col("inside") == i, F.col("z"))), F.lit(0.0)).alias(f"s_{side}") for i, side in ((1, "in"), (0, "out"))])
    norms = F.broadcast(decoder_norms)  # one model's decoder
    contrast = F.round((_mean(F.col("s_in"), F.col("n_in")) - _mean(F.col("s_out"), F.col("n_out"))) * F.col("norm"), digits)
    heard = sums.join(sizes, "accession").join(norms, "feature_id").select("feature_id", contrast.alias("contrast"), F.lit(1).cast("long").alias("times"))
    silent = decoder_norms.select("feature_id").join(heard.groupBy("feature_id").agg(F.count("*").alias("heard")), "feature_id", "left").join(F.broadcast(sizes.agg(F.count("*").alias("all"))))
    silent = silent.select("feature_id", F.lit(0.0).alias("contrast"), (F.col("all") - F.coalesce("heard", F.lit(0))).alias("times")).filter("times > 0")
    rows = heard.unionByName(silent)
    times = F.col("times")
    means = rows.groupBy("feature_id").agg(
        (F.sum(F.col("contrast") * times) / F.sum(times)).alias("mean_contrast"), (F.sum(F.when(F.col("contrast") > 0, times).otherwise(0)) / F.sum(times)).alias("frac_positive"), F.sum(times).alias("n_proteins")
    )
    medians = quantiles(rows, ["feature_id"], "contrast", [0.5], weight="times").select("feature_id", F.get("q", F.lit(0)).alias("median_contrast"))
    return means.join(medians, "feature_id").select("feature_id", "mean_contrast", "median_contrast", "frac_positive", "n_proteins")


def ablation(dense: DataFrame, decoder_norms: DataFrame) -> DataFrame:
    """accession, pos, feature_id, delta: how far a residue's decoding moves without the feature.

    Leaving one latent out moves the decoding by its activation times the norm of
    its decoder row, so nothing is decoded.
    """
    return dense.join(F.broadcast(decoder_norms), "feature_id").select("accession", "pos", "feature_id", (F.col("z") * F.col("norm")).alias("delta"))


def inside_outside(values: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Means of ``value`` where inside is 1 and where it is 0 (0 without rows), their contrast, and Cohen's d."""
    inside, outside = F.when(F.col("inside") == 1, F.col(value)), F.when(F.col("inside") == 0, F.col(value))
    zero = F.lit(0.0)
    grouped = values.groupBy(*keys).agg(
        F.coalesce(F.avg(inside), zero).alias("mean_in"), F.coalesce(F.avg(outside), zero).alias("mean_out"), F.coalesce(F.stddev_pop(inside), zero).alias("sd_in"),
        F.coalesce(F.stddev_pop(outside), zero).alias("sd_out"), F.count(inside).alias("n_in"), F.count("*").alias("length"),
    )
    d = cohen_d(F.col("mean_in"), F.col("sd_in"), F.col("mean_out"), F.col("sd_out"))
    return grouped.withColumns({"contrast": F.col("mean_in") - F.col("mean_out"), "cohen_d": d}).drop("sd_in", "sd_out")


def contrast_summary(contrasts: DataFrame, keys: list[str]) -> DataFrame:
    return contrasts.groupBy(*keys).agg(
        F.avg("contrast").alias("mean_contrast"), F.median("contrast").alias("median_contrast"), F.avg((F.col("contrast") > 0).cast("double")).alias("frac_positive"), F.count("*").alias("n_proteins")
    )


def precision_recall(values: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """Share of activated positions inside the mask and of the mask that is activated; empty denominators count as one."""
    on = F.col("z") > threshold
    inside = F.col("inside") == 1
    hits = F.count_if(on & inside)
    return values.groupBy(*keys).agg((hits / F.greatest(F.count_if(on), F.lit(1))).alias("precision"), (hits / F.greatest(F.count_if(inside), F.lit(1))).alias("recall"))


def self_ablation(active: DataFrame, lengths: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Per (accession, feature): the mean activation where it is high less that elsewhere, positions without activation as zeros."""
    high = F.col("z") > threshold
    sums = active.groupBy("accession", "feature_id").agg(F.sum(F.when(high, F.col("z"))).alias("hi"), F.count_if(high).alias("n_hi"), F.coalesce(F.sum(F.when(~high, F.col("z"))), F.lit(0.0)).alias("lo"))
    joined = sums.filter("n_hi > 0").join(lengths.select("accession", "length"), "accession")
    low = F.coalesce(F.col("lo") / F.nullif((F.col("length") - F.col("n_hi")).cast("double"), F.lit(0.0)), F.lit(0.0))
    return joined.select("accession", "feature_id", (F.col("hi") / F.col("n_hi")).alias("mean_hi"), low.alias("mean_lo")).withColumn("contrast", F.col("mean_hi") - F.col("mean_lo"))


def structural_alignment(residues: DataFrame, masks: DataFrame, decoder: DataFrame) -> DataFrame:
    """annot_type, feature_id, cosine: of each feature's decoder row with the mean embedding inside the type less that outside.

    Sums over all rows and over each type's rows give both means, so no row is
    repeated for the types that it lies outside of.
    """
    dims = residues.select("accession", "pos", F.posexplode("x").alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    total = dims.groupBy("dim").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    inside = dims.join(masks, ["accession", "pos"]).groupBy("annot_type", "dim").agg(F.sum("v").alias("si"), F.count("*").alias("ni"))
    rest = F.col("n") - F.col("ni")
    direction = inside.join(F.broadcast(total), "dim").filter("n > ni").select("annot_type", "dim", (F.col("si") / F.col("ni") - (F.col("s") - F.col("si")) / rest).alias("d"))
    rows = decoder.select("feature_id", F.posexplode("w").alias("dim", "w"))
    both = direction.join(F.broadcast(rows), "dim").groupBy("annot_type", "feature_id").agg(F.sum(F.col("d") * F.col("w")).alias("dot"), F.sum(F.col("d") ** 2).alias("dd"), F.sum(F.col("w") ** 2).alias("ww"))
    return both.select("annot_type", "feature_id", (F.col("dot") / F.nullif(F.sqrt("dd") * F.sqrt("ww"), F.lit(0.0))).alias("cosine"))


def convergence(scores: DataFrame, focal: DataFrame, n: int = 5) -> DataFrame:
    """For each focal (feature, type) the other features of the type, best first, at most ``n``."""
    pairs = focal.select(F.col("feature_id").alias("focal_id"), "annot_type").join(scores, "annot_type").filter("feature_id != focal_id")
    order = Window.partitionBy("focal_id", "annot_type").orderBy(F.desc("auprc_mean"), "feature_id")
    return pairs.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n).select("focal_id", "annot_type", "feature_id", "auprc_mean", "odds_ratio", "n_proteins", "nth")


def regimes(scores: DataFrame, threshold: float) -> DataFrame:
    """``scores`` with precision, residues_per_protein and regime: motif up to ``threshold``, domain above or unknown."""
    rpp = per_protein(F.col("tp"), F.col("n_proteins"))
    regime = F.when(rpp <= threshold, "motif").otherwise("domain")
    return scores.withColumns({"precision": precision(F.col("tp"), F.col("fp")), "residues_per_protein": rpp}).withColumn("regime", regime)


#: Digits that values are counted by before the mixture is fitted, its steps, and the least variance.
MIXTURE_DIGITS, MIXTURE_STEPS, LEAST_VARIANCE = 3, 100, 1e-6


def two_normals(values: np.ndarray, counts: np.ndarray, steps: int = MIXTURE_STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, variances, shares) of a mixture of two normals over counted values, by expectation and maximization.

    It starts from the least and the largest value with the variance of all, so it
    comes out the same each time.
    """
    total = counts.sum()
    mean = (values * counts).sum() / total
    spread = max((values * values * counts).sum() / total - mean * mean, LEAST_VARIANCE)
    means, variances, shares = np.array([values.min(), values.max()]), np.array([spread, spread]), np.array([0.5, 0.5])
    for _ in range(steps):
        logs = np.log(np.maximum(shares, 1e-12)) - 0.5 * np.log(variances) - (values[:, None] - means) ** 2 / (2 * variances)
        second = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        weight = np.stack([1 - second, second], 1) * counts[:, None]
        mass = weight.sum(0)
        shares = mass / total
        means = (weight * values[:, None]).sum(0) / np.maximum(mass, 1e-12)
        variances = np.maximum((weight * (values[:, None] - means) ** 2).sum(0) / np.maximum(mass, 1e-12), LEAST_VARIANCE)
    return means, variances, shares


def regime_threshold(scores: DataFrame) -> float | None:
    """Between the two components of a normal mixture over the logarithm of residues per protein; none without rows.

    Values are counted at ``MIXTURE_DIGITS`` digits: the logarithm of a length has a
    few thousand of these at most, whatever the number of rows, and the steps are
    taken over the counts.
    """
    values = scores.select(F.round(F.log1p(per_protein(F.col("tp"), F.col("n_proteins"))), MIXTURE_DIGITS).alias("v")).dropna()
    rows = values.groupBy("v").agg(F.count("*").alias("n")).orderBy("v").collect()  # bounded by the digits
    if not rows:
        return None
    means, _, _ = two_normals(np.array([r["v"] for r in rows]), np.array([r["n"] for r in rows], float))
    return float(np.expm1(means).mean())


def regime_filter(scored: DataFrame, quantile: float = 0.1, least_clusters: dict[str, int] | None = None) -> DataFrame:
    """Rows at or above the regime's quantile of precision, with enough clusters for the regime."""
    least = least_clusters or {"domain": 30, "motif": 5}
    bars = quantiles(scored, ["regime"], "precision", [quantile]).withColumn("bar", F.get("q", F.lit(0))).drop("q")
    enough = F.lit(False)
    for regime, n in least.items():
        enough = enough | ((F.col("regime") == regime) & (F.col("n_clusters") >= n))
    return scored.join(F.broadcast(bars), "regime").filter((F.col("precision") >= F.col("bar")) & enough).drop("bar")


def balanced(scored: DataFrame, n: int) -> DataFrame:
    """Half of ``n`` from each regime by score, domains first."""
    order = Window.partitionBy("regime").orderBy(F.desc("auprc_mean"), "feature_id", "annot_type")
    return scored.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n // 2)


def positional_profile(active: DataFrame, lengths: DataFrame, features: DataFrame, bins: int = 50) -> DataFrame:
    """feature_id, bin, mean_z, sd_z, n: over bins of the relative position (pos - 1) / (L - 1); the end itself lies in no bin.

    Positions without activation are zeros.  How many positions a bin has follows
    from the lengths, of which each is looked at once.
    """
    span = F.greatest(F.col("length") - 1, F.lit(1))
    own = active.join(lengths.select("accession", "length"), "accession").withColumn("bin", F.expr("cast(((pos - 1) * cast({} as long)) div greatest(length - 1, 1) as int)".format(bins))).filter(F.col("bin") < bins)
    sums = own.groupBy("feature_id", "bin").agg(F.sum("z").alias("s"), F.sum(F.col("z") * F.col("z")).alias("ss"))
    first = lambda b: F.ceil(b * span / F.lit(bins))
    sizes = lengths.filter("length > 0").groupBy("length").agg(F.count("*").alias("m")).select("m", "length", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    sizes = sizes.select("bin", (F.col("m") * (first(F.col("bin") + 1) - first(F.col("bin")))).alias("n")).groupBy("bin").agg(F.sum("n").alias("n")).filter("n > 0")  # a row for each bin
    grid = features.select("feature_id").join(F.broadcast(sizes))
    mean = F.coalesce(F.col("s"), F.lit(0.0)) / F.col("n")
    out = grid.join(sums, ["feature_id", "bin"], "left").withColumn("mean_z", mean)
    return out.select("feature_id", "bin", "mean_z", F.sqrt(F.greatest(F.coalesce(F.col("ss"), F.lit(0.0)) / F.col("n") - F.col("mean_z") ** 2, F.lit(0.0))).alias("sd_z"), "n")


def resampled(values: DataFrame, lengths: DataFrame, bins: int = 100, value: str = "z", keys: tuple[str, ...] = ("accession", "feature_id")) -> DataFrame:
    """keys, bin and the mean of ``value`` over the slice of positions of each bin, one position at least; positions without a row are zeros.

    Bins without any row are left out.  A row goes straight to the bins whose slice
    has its position, one of them unless there are more bins than positions.
    """
    joined = values.join(lengths.select("accession", "length"), "accession").withColumn("_i", F.col("pos").cast("long") - 1)
    size = F.col("length")
    up = lambda x: F.ceil(x * bins / size)
    first, last = F.least(up(F.col("_i") + 1) - 1, up(F.col("_i"))), F.least(F.floor(((F.col("_i") + 1) * bins - 1) / size), F.lit(bins - 1))
    dealt = joined.withColumn("bin", F.explode(F.sequence(F.greatest(first - 1, F.lit(0)), last)))
    low = F.expr(f"(bin * length) div {bins}")
    high = F.greatest(F.expr(f"((bin + 1) * length) div {bins}"), low + 1)
    inside = dealt.filter((F.col("_i") >= low) & (F.col("_i") < high))
    return inside.groupBy(*keys, F.col("bin").cast("int").alias("bin")).agg(F.sum(F.col(value) / (high - low)).alias(value))


def filled(sparse: DataFrame, lengths: DataFrame, features: DataFrame, bins: int, value: str = "z") -> DataFrame:
    """``resampled`` activations with zeros for what is silent: a row for each accession, feature and bin."""
    ids = [r["feature_id"] for r in features.select("feature_id").collect()]  # one model's features
    cells = lengths.select("accession", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    grid = cells.select("accession", "bin", F.explode(F.array(*[F.lit(i).cast("long") for i in ids])).alias("feature_id"))
    return grid.join(sparse, ["accession", "feature_id", "bin"], "left").select("accession", "feature_id", "bin", F.coalesce(value, F.lit(0.0)).alias(value))


def logit_delta(logits: DataFrame, without: DataFrame) -> DataFrame:
    """accession, pos, delta: the true token's log-probability with the feature less that without.

    Both tables have accession, pos, token and logits; a provider of the language
    model makes them.
    """

    def log_probability(c: str):
        top = F.array_max(c)
        return F.get(c, F.col("token")) - top - F.ln(F.aggregate(c, F.lit(0.0), lambda s, x: s + F.exp(x - top)))

    both = logits.join(without.select("accession", "pos", F.col("logits").alias("other")), ["accession", "pos"])
    return both.select("accession", "pos", (log_probability("logits") - log_probability("other")).alias("delta"))


def scorecard(evidence: DataFrame) -> DataFrame:
    """Which lines of evidence pass, and how many."""
    rules = {
        "pass_auprc": F.col("auprc_mean") > 0.3, "pass_physico": F.abs("max_abs_d") > 0.2, "pass_ablation": F.col("frac_positive") > 0.6, "pass_convergence": F.col("n_features") >= 3,
        "pass_structure": F.col("cosine") > 0.1, "pass_logit": F.col("logit_frac") > 0.6,
    }
    flags = {k: F.coalesce(v, F.lit(False)) for k, v in rules.items() if all(c in evidence.columns for c in _names(k))}
    return evidence.withColumns(flags).withColumn("n_passed", sum(F.col(k).cast("int") for k in flags))


def _names(rule: str) -> tuple[str, ...]:
    return {
        "pass_auprc": ("auprc_mean",), "pass_physico": ("max_abs_d",), "pass_ablation": ("frac_positive",), "pass_convergence": ("n_features",), "pass_structure": ("cosine",), "pass_logit": ("logit_frac",),
    }[rule]


def quadrants(triaged: DataFrame, auprc: float = 0.25, contrast: float = 0.05) -> DataFrame:
    """Known or unknown by score, causal or not by the effect of leaving the feature out."""
    known, causal = F.col("best_auprc") >= auprc, F.col("abl_contrast") > contrast
    label = F.when(~known & causal, "novel").when(known & causal, "known").when(known, "correlated").otherwise("silent")
    return triaged.withColumn("quadrant", label)
