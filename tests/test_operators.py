"""Hand-worked cases of the operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from helixframe.catalogue import reports as catalogue_reports
from helixframe.operators import alignment as A
from helixframe.operators import attention, batching, encoding, evidence, figures, intervals, prep, reports
from helixframe.operators.quantiles import quantiles


def test_masks_union_and_validity(spark):
    ann = spark.createDataFrame([("p", "T", 3, 5), ("p", "T", 5, 7), ("p", "T", 9, 12), ("q", "T", 0, 0)], "accession string, feature_type string, start int, end int")
    lengths = spark.createDataFrame([("p", 10), ("q", 5)], "accession string, length int")
    assert sorted(r["pos"] for r in intervals.masks(ann, lengths).collect()) == [3, 4, 5, 6, 7, 9, 10]
    assert prep.valid_types(ann.filter("accession = 'p'"), 10, 1).first()["n_residues"] == 10
    assert [tuple(r)[2:] for r in intervals.runs(intervals.masks(ann, lengths), ["accession", "annot_type"]).orderBy("first").collect()] == [(3, 7, 5), (9, 10, 2)]


def _many_intervals(spark):
    rng = random.Random(5)
    rows = [(a, rng.choice("TU"), s := rng.randint(-2, 30), s + rng.randint(-1, 6)) for a in range(40) for _ in range(rng.randint(0, 7))]
    ann = spark.createDataFrame(rows, "accession long, feature_type string, start int, end int")
    return ann, spark.createDataFrame([(a, 10 + a % 20) for a in range(40)], "accession long, length int")


def test_extents_and_runs_of_intervals_are_those_of_positions(spark):
    ann, lengths = _many_intervals(spark)
    seen = intervals.masks(ann, lengths)
    keys = ["accession", "annot_type"]
    extents = seen.groupBy(*keys).agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    for from_intervals, by_position in ((intervals.extents(ann, lengths), extents), (intervals.mask_runs(ann, lengths), intervals.runs(seen, keys))):
        assert from_intervals.dtypes == by_position.dtypes
        assert sorted(from_intervals.collect()) == sorted(by_position.collect())
        assert "Generate" not in from_intervals._jdf.queryExecution().optimizedPlan().toString()


def test_intervals_are_dealt_by_their_number(spark, monkeypatch):
    """Twice the annotations are twice the tasks; contours and coverage stay where the intervals are, whatever the number of shuffle partitions."""
    ann, lengths = _many_intervals(spark)
    n = ann.count()
    whole = sorted(intervals.coverage(ann, lengths).collect())
    monkeypatch.setattr(intervals.tasks_for, "__defaults__", (n // 20,))
    apart = intervals.merged_types(ann, lengths, ("length",))
    assert apart.rdd.getNumPartitions() == -(-n // (n // 20))
    cells = intervals.binned_share(apart, None, ["accession", "annot_type"], 5)
    assert intervals.contour(cells, ["accession", "annot_type"]).rdd.getNumPartitions() == apart.rdd.getNumPartitions()
    covered = intervals.coverage(ann, lengths)
    assert covered.rdd.getNumPartitions() == apart.rdd.getNumPartitions()
    assert sorted(covered.collect()) == whole


SCORES = [0.9, 0.5, 0.5, 0.0, 0.0, 0.0]
MARKS = [1, 0, 1, 1, 0, 0]


def _case(spark, parts=1):
    active = spark.createDataFrame([("p", i + 1, 7, z) for i, z in enumerate(SCORES) if z > 0], "accession string, pos int, feature_id long, z double").repartition(parts)
    masks = spark.createDataFrame([("p", "T", i + 1) for i, y in enumerate(MARKS) if y], "accession string, annot_type string, pos int").repartition(parts)
    lengths = spark.createDataFrame([("p", 6, "c")], "accession string, length int, cluster_id string")
    return active, masks, lengths


@pytest.mark.parametrize("parts", [1, 5])
def test_confusion_and_average_precision(spark, parts):
    """The counts don't depend on how rows are dealt out."""
    active, masks, lengths = _case(spark, parts)
    pairs = A.confusion(active, masks, lengths)
    row = pairs.first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"], row["odds_ratio"]) == (2, 1, 1, 2, 4.0)
    assert row["tp"] + row["fp"] + row["fn"] + row["tn"] == row["length"]
    assert abs(row["enrichment"] - 1.428571) < 1e-6
    assert abs(A.ap_rows(pairs, active, masks).first()["ap"] - 0.805556) < 1e-6
    assert abs(A.ap_ties(pairs, active, masks).first()["ap"] - 0.722222) < 1e-6


def test_cluster_weights(spark):
    rows = [(1, "T", "c1", 0.8, 1.0, 4, 0, 0, 0), (1, "T", "c1", 0.6, 1.0, 2, 0, 0, 0), (1, "T", "c2", 0.5, 1.0, 5, 0, 0, 0)]
    df = spark.createDataFrame(rows, "feature_id long, annot_type string, cluster_id string, ap double, enrichment double, tp int, fp int, fn int, tn int")
    r = A.by_cluster(df).first()
    assert (round(r["auprc_mean"], 6), round(r["auprc_median"], 6), r["n_proteins"], r["n_clusters"], r["tp"], r["enrichment_gmean"]) == (0.6, 0.6, 3, 2, 8.0, 1.0)
    assert r["odds_ratio"] is None and r["fisher_p"] == 1.0


def test_best_skips_missing_scores(spark):
    df = spark.createDataFrame([("T", 3, float("nan"), 1), ("T", 2, 0.4, None), ("T", 1, 0.4, 5), ("U", 9, None, 2)], "annot_type string, feature_id long, auprc_mean double, b int")
    got = {r["annot_type"]: (r["feature_id"], r["b"]) for r in A.best_of(df, "annot_type").collect()}
    assert got == {"T": (1, 5), "U": (9, 2)}


def test_triage_and_empty_candidates(spark):
    df = spark.createDataFrame([(1, "T", 0.6, float("inf")), (1, "U", 0.4, 3.0), (2, "T", 0.1, 2.0)], "feature_id long, annot_type string, auprc_mean double, odds_ratio double")
    rows = {r["feature_id"]: r for r in A.triage(df).collect()}
    assert (rows[1]["best_annot"], rows[1]["n_above_low"], rows[1]["n_above_high"], rows[1]["max_odds_ratio"], rows[1]["mystery"]) == ("T", 2, 1, 3.0, 0.4)
    assert [r["feature_id"] for r in A.novel(A.triage(df)).collect()] == [2]
    empty = A.novel(A.triage(df), 0.0)
    assert empty.count() == 0 and "best_annot" in empty.columns


def test_split_and_subset_match_a_loop(spark):
    for seed in range(3):
        rng = random.Random(seed)
        sizes = {i: rng.randrange(1, 9) for i in range(60)}
        df = spark.createDataFrame(list(sizes.items()), "cluster_id long, size long")
        order = [r[0] for r in df.orderBy(prep.shuffled("cluster_id", 42), "cluster_id").collect()]
        total = sum(sizes.values())
        expected, done = {}, {"train": 0, "val": 0, "test": 0}
        for c in order:
            where = "train" if done["train"] < 0.7 * total else "val" if done["val"] < 0.15 * total else "test"
            expected[c] = where
            done[where] += sizes[c]
        got = {r["cluster_id"]: r["split"] for r in prep.cluster_split(df).collect()}
        assert got == expected
        taken, kept = 0, []
        for c in order:
            if taken < 50:
                kept.append(c)
                taken += sizes[c]
        assert sorted(r["cluster_id"] for r in prep.cluster_subset(df, 50).collect()) == sorted(kept)
        assert [r["cluster_id"] for r in prep.cluster_subset(df, 0).collect()] == order[:1]
    with pytest.raises(ValueError):
        prep.cluster_split(df, 0.9, 0.2)


def test_joins_check_their_keys(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (2, "y")], "k int, w string")
    assert prep.join_many_to_one(left, right, "k").count() == 2
    with pytest.raises(ValueError, match="not unique"):
        prep.join_one_to_one(left, right, "k")
    with pytest.raises(ValueError, match="not unique"):
        prep.join_many_to_one(right, left, "k")
    with pytest.raises(ValueError, match="missing columns: z"):
        prep.required(left, ["k", "z"])


def test_dedup_keys(spark):
    df = spark.createDataFrame([("p", "T", 1, 2, "x"), ("p", "T", 1, 2, "y")], "accession string, feature_type string, start int, end int, description string")
    keys = ["accession", "feature_type", "start", "end"]
    assert [r["description"] for r in prep.first_of_each(df, keys, ["description"]).collect()] == ["x"]
    assert prep.first_of_each(df, [*keys, "description"], ["description"]).count() == 2
    assert [r["group_size"] for r in prep.duplicate_groups(df, keys).collect()] == [2, 2]


def test_sequence_cleaning(spark):
    df = spark.createDataFrame([(1, " acd "), (2, "AXB"), (3, ""), (4, None), (5, "nan"), (6, "A" * 1030)], "accession int, sequence string")
    got = {r["accession"]: (r["skip_reason"], r["used"]) for r in prep.with_skip_reasons(df).collect()}
    assert got == {1: (None, "ACD"), 2: ("alphabet", None), 3: ("empty", None), 4: ("empty", None), 5: ("empty", None), 6: (None, "A" * 1022)}


def test_subtypes_are_promoted_only_if_finer(spark):
    fine = spark.createDataFrame([("T", "T: a"), ("T", "T: b"), ("T", "T: c"), ("U", None)], "feature_type string, annot_subtype string")
    assert sorted(r["feature_type"] for r in prep.promoted_subtypes(fine).collect()) == ["T: a", "T: b", "T: c", "U"]
    same = spark.createDataFrame([("T", "T"), ("U", "U")], "feature_type string, annot_subtype string")
    assert sorted(r["feature_type"] for r in prep.promoted_subtypes(same).collect()) == ["T", "U"]
    assert prep.promoted_subtypes(fine.drop("annot_subtype")).columns == ["feature_type"]


def test_feature_statistics(spark):
    active = spark.createDataFrame([("A", 2, 1, 2.0), ("B", 1, 1, 1.0), ("B", 2, 1, 1.0)], "accession string, pos int, feature_id long, z double")
    lengths = spark.createDataFrame([("A", 4), ("B", 2)], "accession string, length int")
    r = encoding.feature_stats(active, lengths).first()
    assert (r["mean"], r["variance"], r["max"], round(r["sparsity"], 6)) == (0.75, 0.4375, 2.0, 3.199995)


def test_encode_options(spark):
    residues = spark.createDataFrame([("p", 1, [1.0, 0.0]), ("p", 2, [0.5, 0.5])], "accession string, pos int, x array<double>")
    weights = spark.createDataFrame([(0, [1.0, 0.0], 0.0), (1, [1.0, 0.0], 0.0), (2, [0.0, 1.0], -0.25)], "feature_id long, w array<double>, b double")
    rows = lambda **k: sorted((r["pos"], r["feature_id"], r["z"]) for r in encoding.encode(residues, weights, **k).collect())
    assert rows(bias=True) == [(1, 0, 1.0), (1, 1, 1.0), (2, 0, 0.5), (2, 1, 0.5), (2, 2, 0.25)]
    assert rows(topk=1) == [(1, 0, 1.0), (2, 0, 0.5)]
    assert rows(mean=[1.0, 0.0], sd=[1.0, 0.5]) == [(2, 2, 1.0)]


def test_ablation_is_the_norm_of_the_difference(spark):
    z = [0.4, 0.0, 1.2]
    w = [[1.0, 2.0], [0.5, 0.5], [-1.0, 0.3]]
    dense = spark.createDataFrame([("p", 1, k, v) for k, v in enumerate(z)], "accession string, pos int, feature_id long, z double")
    norms = spark.createDataFrame([(k, (a * a + b * b) ** 0.5) for k, (a, b) in enumerate(w)], "feature_id long, norm double")
    got = {r["feature_id"]: r["delta"] for r in evidence.ablation(dense, norms).collect()}
    for k in range(3):
        whole = [sum(z[j] * w[j][d] for j in range(3)) for d in range(2)]
        less = [sum(z[j] * w[j][d] for j in range(3) if j != k) for d in range(2)]
        assert abs(got[k] - sum((a - b) ** 2 for a, b in zip(whole, less, strict=True)) ** 0.5) < 1e-12


def test_relative_bins_drop_the_end(spark):
    values = spark.createDataFrame([("p", i, 1, 1.0) for i in range(1, 6)], "accession string, pos int, feature_id long, z double")
    lengths = spark.createDataFrame([("p", 5)], "accession string, length int")
    assert sorted(r["bin"] for r in evidence.positional_profile(values, lengths, values.select("feature_id").distinct()).filter("mean_z > 0").collect()) == [0, 12, 25, 37]


def laid_out(spark, seed):
    """(active, intervals, lengths, features) and every position as (accession, pos, feature, inside, z)."""
    rng = random.Random(seed)
    active, intervals_, lengths, grid = [], [], [], []
    for p in range(14):
        n = rng.choice([1, 2, 3, 7, 64, 65, 130, 200])
        lengths.append((p, n))
        covered = {i for i in range(1, n + 1) if (i // 9) % 3 == 0} if p % 4 else set()
        for i in sorted(covered):
            if i - 1 not in covered:
                intervals_.append((p, i, next(j for j in range(i, n + 1) if j + 1 not in covered)))
        for i in range(1, n + 1):
            for f in range(4):
                z = rng.random() if f < 3 and rng.random() < [0.3, 0.02, 0.9][f] else 0.0
                grid.append((p, i, f, int(i in covered), z))
                if z:
                    active.append((p, i, f, z))
    make = spark.createDataFrame
    frames = make(active, "accession long, pos int, feature_id long, z double"), make(intervals_, "accession long, a int, b int"), make(lengths, "accession long, length int"), make([(f,) for f in range(4)], "feature_id long")
    return frames, make(grid, "accession long, pos int, feature_id long, inside int, z double").cache()


def close(got, want):
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    rows = [sorted(([v if v is None else round(float(v), 8) + 0.0 for v in r] for r in df.select(order).collect()), key=repr) for df in (got, want)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("seed", [1, 2])
def test_evidence_without_a_grid(spark, seed):
    """Sums of activations with counts of zeros against the same figures over every position and feature."""
    (active, masks, lengths, features), grid = laid_out(spark, seed)
    names = ["feature_id", "mean_in", "mean_out", "contrast", "cohen_d", "n_in", "length"]
    close(evidence.sparse_contrast(active, masks, lengths, features).select(names), evidence.inside_outside(grid, "z", ["feature_id"]).select(names))
    close(evidence.sparse_precision_recall(active, masks, lengths, features, 0.5), evidence.precision_recall(grid, 0.5, ["feature_id"]))
    norms = features.select("feature_id", (F.col("feature_id") + 0.5).alias("norm"))
    per = evidence.inside_outside(grid.join(norms, "feature_id").withColumn("d", F.col("z") * F.col("norm")), "d", ["accession", "feature_id"]).filter("n_in > 0").withColumn("contrast", F.round("contrast", 9))
    close(evidence.ablation_summary(active, masks, lengths, norms), evidence.contrast_summary(per, ["feature_id"]))
    own = evidence.inside_outside(grid, "z", ["accession", "feature_id"]).filter("n_in > 0").withColumn("contrast", F.round("contrast", 6))
    close(evidence.best_contrasts(active, masks, lengths, features), figures.best_accession(own, ["feature_id"]).select("feature_id", "accession", "contrast"))
    for bins in (3, 50):
        at = F.floor(F.round((F.col("pos") - 1) / F.greatest(F.col("length") - 1, F.lit(1)) * bins, 9)).cast("int")
        dense = grid.join(lengths, "accession").withColumn("bin", at).filter(F.col("bin") < bins)
        want = dense.groupBy("feature_id", "bin").agg(F.avg("z").alias("mean_z"), F.stddev_pop("z").alias("sd_z"), F.count("*").alias("n"))
        close(evidence.positional_profile(active, lengths, features, bins).withColumn("sd_z", F.round("sd_z", 6)), want.withColumn("sd_z", F.round("sd_z", 6)))
        cells = lengths.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn("low", F.floor(F.col("bin") * F.col("length") / bins))
        cells = cells.withColumn("high", F.greatest(F.floor((F.col("bin") + 1) * F.col("length") / bins), F.col("low") + 1))
        want = cells.join(grid, "accession").filter("pos > low and pos <= high").groupBy("accession", "feature_id", "bin").agg(F.avg("z").alias("z"))
        close(evidence.filled(evidence.resampled(active, lengths, bins), lengths, features, bins), want)
    whole = evidence.ablation_summary(active, masks, lengths, norms)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in whole


def test_hits_by_bins_are_those_by_position(spark):
    (active, masks, lengths, _), grid = laid_out(spark, 3)
    typed = masks.withColumn("annot_type", F.col("accession") % 2).unionByName(masks.select("accession", "a", "b", F.lit(7).cast("long").alias("annot_type")))
    positions = typed.select("accession", "annot_type", F.explode(F.sequence("a", "b")).alias("pos"))
    clusters = lengths.withColumn("cluster_id", F.col("accession") % 3)
    close(A.confusion(active, typed, clusters), A.confusion(active, positions, clusters))
    pairs = A.confusion(active, typed, clusters)
    close(A.ap_ties(pairs, active, typed), A.ap_ties(pairs, active, positions))
    close(A.ap_rows(pairs, active, typed), A.ap_rows(pairs, active, positions))
    close(intervals.as_intervals(positions, ["accession", "annot_type"]), typed)


@pytest.mark.parametrize("n", [1, 2, 5, 3001])
def test_quantiles(spark, n):
    """One group of all rows, ties, few values, nulls and weights against Spark's own buffer."""
    rows = [(None if i % 50 == 1 else f"g{i % 3}" if i % 4 == 0 else "hot", "x", float(i * 7919 % 97) if i % 5 else float(i), 1 + i % 3) for i in range(n)] + [("none", "x", None, 1)]
    df = spark.createDataFrame(rows, "g string, h string, v double, w long").repartition(6)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    for keys, weight in ((["g"], None), (["g", "h"], "w"), ([], None)):
        q = F.percentile("v", F.array(*map(F.lit, probs)), F.lit(1) if weight is None else F.col(weight))
        want = df.groupBy(*keys).agg(q.alias("q")).filter("q is not null")
        got = quantiles(df, keys, "v", probs, weight)
        show = lambda out: sorted(repr([*r[: len(keys)], *[round(x, 9) for x in r["q"]]]) for r in out.collect())
        assert show(got) == show(want)


def test_ridge_is_that_of_a_histogram_and_lines(spark):
    rng = np.random.default_rng(1)
    values = {"a": rng.uniform(-0.1, 1.1, 300), "b": np.array([0.0, 0.0, 1.0, 1.0, 0.5]), "c": np.array([0.1] * 4)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), (None, 0.5)], "t string, v double").repartition(4)
    got = {}
    for r in reports.density_ridge(df, "t", "v").collect():
        got.setdefault(r["t"], {})[r["point"]] = r
    assert set(got) == {"a", "b"}
    for k, own in got.items():
        counts, edges = np.histogram(values[k], bins=80, range=(0, 1), density=True)
        ys = np.interp(np.linspace(0, 1, 200), (edges[:-1] + edges[1:]) / 2, counts)
        assert np.allclose([own[i]["y"] for i in range(200)], ys / ys.max() * 0.85) and np.allclose([own[i]["x"] for i in range(200)], np.linspace(0, 1, 200))
        assert own[0]["median"] == pytest.approx(np.median(values[k]))


def test_width_follows_the_length(spark):
    rng = np.random.default_rng(2)
    own = {n: rng.normal(size=n) for n in (1, 2, 3, 10, 149, 200, 260, 500)}
    df = spark.createDataFrame([(n, i + 1, float(v)) for n, vs in own.items() for i, v in enumerate(vs)], "p long, pos int, v double").repartition(4)
    got = {(r["p"], r["pos"]): r["smooth"] for r in reports.width_average(df, "v", ["p"]).collect()}
    for n, vs in own.items():
        w = max(3, n // 50)
        padded = np.concatenate([np.zeros(w // 2), vs, np.zeros((w - 1) // 2)])
        want = [padded[i : i + w].sum() / w for i in range(n)]
        assert n < w or np.allclose(want, np.convolve(vs, np.ones(w) / w, mode="same"))
        assert np.allclose([got[n, i + 1] for i in range(n)], want)


def test_contour_over_bins(spark):
    lengths = spark.createDataFrame([("p", 37), ("q", 4), ("r", 100)], "accession string, length int")
    masks = {("p", 1): [(3, 9), (12, 12), (30, 37)], ("q", 1): [(2, 3)], ("r", 2): [(1, 100)], ("r", 1): [(5, 5)]}
    df = spark.createDataFrame([(a, t, x, y) for (a, t), own in masks.items() for x, y in own], "accession string, t int, a int, b int")
    got = {(r["accession"], r["t"], r["first"], r["last"], r["x"], r["width"]) for r in intervals.contour(intervals.binned_share(df, lengths, ["accession", "t"], 10), ["accession", "t"]).collect()}
    want = set()
    for (a, t), own in masks.items():
        n = {"p": 37, "q": 4, "r": 100}[a]
        mask = np.array([any(x <= i <= y for x, y in own) for i in range(1, n + 1)], float)
        share = [mask[b * n // 10 : max((b + 1) * n // 10, b * n // 10 + 1)].mean() for b in range(10)]
        begun = None
        for b, v in enumerate([*share, 0.0]):  # as it is drawn, bin after bin
            if v > 0.3 and begun is None:
                begun = b
            elif v <= 0.3 and begun is not None:
                want.add((a, t, begun, b - 1, begun - 0.5, b - begun))
                begun = None
    assert got == want and len(want) == 4


def test_two_normals():
    rng = np.random.default_rng(3)
    values, counts = np.unique(np.concatenate([rng.normal(1, 0.2, 4000), rng.normal(3, 0.4, 2000)]).round(3), return_counts=True)
    means, variances, shares = evidence.two_normals(values, counts.astype(float))
    assert np.allclose(means, [1, 3], atol=0.05) and np.allclose(np.sqrt(variances), [0.2, 0.4], atol=0.03) and np.allclose(shares, [2 / 3, 1 / 3], atol=0.02)
    means, _, _ = evidence.two_normals(np.array([2.0]), np.array([5.0]))
    assert np.allclose(means, 2)


def test_physico_counts_residues_without_a_value(spark):
    residues = spark.createDataFrame([("A", 1), ("X", 1), ("R", 0)], "residue string, inside int")
    scales = spark.createDataFrame([("A", "h", 2.0), ("R", "h", -1.0)], "residue string, property string, value double")
    r = evidence.physico_contrast(residues, scales).first()
    assert (r["mean_in"], r["mean_out"], r["contrast"], r["n_in"], r["n_out"]) == (2.0, -1.0, 3.0, 2, 1)


def test_logit_delta(spark):
    a = spark.createDataFrame([("p", 1, 0, [2.0, 0.0])], "accession string, pos int, token int, logits array<double>")
    b = spark.createDataFrame([("p", 1, 0, [0.0, 0.0])], "accession string, pos int, token int, logits array<double>")
    assert abs(evidence.logit_delta(a, b).first()["delta"] - 0.566219) < 1e-6


def test_scorecard(spark):
    df = spark.createDataFrame([(1, 0.5, 0.1, 0.7, 3, None), (2, 0.2, 0.3, 0.5, 2, 0.2)], "feature_id int, auprc_mean double, max_abs_d double, frac_positive double, n_features int, cosine double")
    got = {r["feature_id"]: r["n_passed"] for r in evidence.scorecard(df).collect()}
    assert got == {1: 3, 2: 2}


def test_attention_axes(spark):
    """Sent sums over keys, received over queries."""
    weights = {(1, 1): 0.9, (1, 2): 0.1, (2, 1): 0.6, (2, 2): 0.2}
    df = spark.createDataFrame([("p", 1, 1, q, k, w) for (q, k), w in weights.items()], "accession string, layer int, head int, query int, key int, weight double")
    got = {(r["attn_agg"], r["pos"]): round(r["score"], 5) for r in attention.profiles(df).collect()}
    assert got["mean_sent", 1] == 1.0 and got["mean_sent", 2] == 0.0 and got["mean_received", 1] == 1.0 and got["layer_01_sent", 1] == 1.0
    assert {a for a, _ in got} == {"mean_sent", "max_sent", "mean_received", "last_layer_sent", "layer_01_sent"}


def test_attention_of_proteins_with_several_layers(spark):
    """The last layer is the protein's own; means are over heads and layers, the largest is over both."""
    rows = [("p", layer, head, q, k, float(layer * head * q * q + k)) for layer in (1, 2) for head in (1, 2) for q in (1, 2, 3) for k in (1, 2, 3)] + [("q", 1, 1, q, k, float(k * k - q)) for q in (1, 2) for k in (1, 2)]
    for dealt in (1, 6):
        df = spark.createDataFrame(rows, "accession string, layer int, head int, query int, key int, weight double").repartition(dealt)
        got = {(r["accession"], r["attn_agg"], r["pos"]): round(r["score"], 6) for r in attention.profiles(df).collect()}
        assert len(got) == 3 * 6 + 2 * 5
        assert [got["p", "mean_sent", n] for n in (1, 2, 3)] == [got["p", "last_layer_sent", n] for n in (1, 2, 3)] == [got["p", "layer_02_sent", n] for n in (1, 2, 3)] == [0, 0.375, 1]
        assert [got["p", "mean_received", n] for n in (1, 2, 3)] == [0, 0.5, 1] and [got["q", "last_layer_sent", n] for n in (1, 2)] == [1, 0] and [got["q", "mean_received", n] for n in (1, 2)] == [0, 1]


def test_attention_weights_are_made_once(spark, tiny):
    plan = __spark_entry__.queries()["attention_reduce"](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_attention_is_dealt_by_the_number_of_residues(spark, tiny, monkeypatch):
    """Scores of layers, from which types of far peaks are chosen, and all other queries on attention start from these tasks."""
    n = spark.read.parquet(f"{tiny}/embeddings.parquet").count()
    monkeypatch.setattr(catalogue_reports, "RESIDUES_OF_TASK", n // 20)
    assert attention.profiles(catalogue_reports._attention(spark, tiny)).rdd.getNumPartitions() == -(-n // (n // 20))


def test_layer_choices(spark):
    rows = [("T", k, 0.1 * k) for k in range(6)] + [("U", k, 0.3) for k in range(6)] + [("V", 0, 0.2), ("V", 1, 0.6)]
    df = spark.createDataFrame(rows, "annot_type string, layer int, auprc double")
    assert [r["annot_type"] for r in attention.varied(df).collect()] == ["T", "V"]
    assert attention.spread_peaks(df, 2) == ["V", "T"]


def test_batches(spark):
    df = spark.createDataFrame([(i, 10 + i % 90) for i in range(200)] + [(900, 0)], "accession long, length int")
    buckets = batching.length_buckets(df, 64, 16)
    assert buckets.filter("accession = 900").count() == 0
    assert buckets.groupBy("bucket", "chunk").count().agg(F.max("count")).first()[0] == 16
    shards = batching.shard_slices(df, 4).groupBy("shard").agg(F.count("*").alias("n"), F.min("accession").alias("a"), F.max("accession").alias("b")).orderBy("shard").collect()
    assert [r["n"] for r in shards] == [51, 51, 51, 48] and all(x["b"] < y["a"] for x, y in zip(shards, shards[1:], strict=False))


def filled(sizes, budget):
    """Batches by one loop over all sizes."""
    batch, tokens, out = 0, 0, []
    for n in sizes:
        if n and tokens and tokens + n > budget:  # what has no size goes to the batch under way
            batch, tokens = batch + 1, 0
        tokens += n
        out.append(batch)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_greedy_batches_are_those_of_one_loop(spark, seed):
    """Whatever the slices: rows of no size, over the budget, over whole slices, and of one size."""
    rng = random.Random(seed)
    budget, width = [(128, 128), (64, 500), (100, 100), (32, 200), (50, 10**6), (7, 7)][seed]
    sizes = [[rng.randint(0, 40), rng.randint(0, 2 * budget), 16, rng.choice([0, 0, 1, 5, 900]), rng.randint(1, 30), rng.choice([0, 7, 3])][seed] for _ in range(700)]
    df = spark.createDataFrame([(i, n if n or i % 2 else None, "x", 1) for i, n in enumerate(sizes)], "accession long, length int, batch string, row int").repartition(5)
    got = {r["accession"]: r["chunk"] for r in batching.boundary_chunks(df.drop("batch"), budget, slice_width=width).collect()}
    assert got == dict(enumerate(filled(sizes, budget)))


def test_token_batches(spark):
    df = spark.createDataFrame([(i, i * 37 % 150) for i in range(600)], "accession long, length int").repartition(4)
    order = sorted(((r["length"], r["accession"]) for r in df.collect()), key=lambda r: (-r[0], r[1]))
    want = dict(zip([a for _, a in order], filled([n + 2 for n, _ in order], 300), strict=True))
    for width in (300, 1000, None):
        assert {r["accession"]: r["batch"] for r in batching.token_batches(df, 300, slice_width=width).collect()} == want
    assert batching.token_batches(df.limit(0), 300).count() == 0
    plan = batching.token_batches(df, 300)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_numbered_splits_a_hot_group(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 40 + 2).alias("g")).repartition(8)
    got = batching.numbered(df, ["g"], [F.col("k")])
    for g in (1, 2):
        rows = sorted((r["k"], r["nth"]) for r in got.filter(f"g = {g}").collect())
        assert [n for _, n in rows] == list(range(len(rows)))
    assert got.count() == 5000 and batching.numbered(df.limit(0), ["g"], [F.col("k")]).count() == 0


def test_owner_choices(spark):
    df = spark.createDataFrame([("A: x", 1, 0.9), ("A: y", 2, 0.8), ("B", 1, 0.7), ("C", 3, 0.6)], "annot_type string, feature_id long, auprc_mean double")
    assert [r["annot_type"] for r in reports.prefix_owners(df, 9).collect()] == ["A: x", "B", "C"]


def test_regimes(spark):
    rows = [(k, "T", 0.5, 10.0 * (1 if k % 2 else 40), 1.0, 10, 50) for k in range(40)]
    df = spark.createDataFrame(rows, "feature_id long, annot_type string, auprc_mean double, tp double, fp double, n_proteins int, n_clusters int")
    threshold = evidence.regime_threshold(df)
    assert 1 < threshold < 40
    scored = evidence.regimes(df, threshold)
    assert scored.filter("regime = 'motif'").count() == 20
    assert evidence.regime_filter(scored).count() == 40
