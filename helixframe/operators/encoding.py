"""Embedding vectors to sparse latent activations, and their statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _activations(x: np.ndarray, w: np.ndarray, b, topk: int | None, digits: int) -> np.ndarray:
    z = np.maximum(np.round(x @ w.T + b, digits), 0.0)
    if topk is not None and topk < z.shape[1]:
        order = np.argsort(-z, axis=1, kind="stable")
        np.put_along_axis(z, order[:, topk:], 0.0, 1)
    return z


def encode(residues: DataFrame, weights: DataFrame, topk: int | None = None, bias: bool = False, mean: list | None = None, sd: list | None = None, digits: int = 9) -> DataFrame:
    """accession, pos, feature_id, z: the activations above 0 of every residue.

    ``weights`` (feature_id, w, and b with ``bias``) is one model's encoder, of a
    size that the model fixes; it is broadcast and multiplied a batch at a time.
    ``topk`` keeps the largest of each residue, ties by feature; ``mean`` and
    ``sd`` standardize the input.  Products are rounded, so that sums in another
    order don't break ties.
    """
    rows = sorted(weights.collect(), key=lambda r: r["feature_id"])
    ids = np.array([r["feature_id"] for r in rows])
    w = np.array([r["w"] for r in rows], float)
    b = np.array([r["b"] for r in rows], float) if bias else 0.0
    shared = residues.sparkSession.sparkContext.broadcast((ids, w, b, mean, sd))

    def run(batches):
        ids, w, b, mean, sd = shared.value
        for batch in batches:
            if not len(batch):
                continue
            x = np.array(batch.column(2).to_pylist(), float)
            if mean is not None:
                x = (x - np.array(mean)) / np.maximum(np.array(sd), 1e-6)
            z = _activations(x, w, b, topk, digits)
            row, feature = np.nonzero(z)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(ids[feature], pa.int64()), pa.array(z[row, feature])], ["accession", "pos", "feature_id", "z"])

    given = residues.select("accession", "pos", "x")
    kind = {f.name: f.dataType.simpleString() for f in given.schema}
    return given.mapInArrow(run, f"accession {kind['accession']}, pos {kind['pos']}, feature_id long, z double")


def feature_stats(active: DataFrame, lengths: DataFrame, n_proteins: int | None = None) -> DataFrame:
    """Per feature mean, variance, max and sparsity over proteins, positions without activation counted as zeros."""
    n = n_proteins if n_proteins is not None else lengths.count()
    per = active.join(lengths, "accession").groupBy("accession", "feature_id", "length").agg(F.sum("z").alias("s"), F.sum(F.col("z") * F.col("z")).alias("s2"), F.max("z").alias("m"), F.count("*").alias("nz"))
    size = F.col("length")
    sums = per.groupBy("feature_id").agg(F.sum(F.col("s") / size).alias("s"), F.sum(F.col("s2") / size).alias("s2"), F.max("m").alias("max"), F.sum(F.col("nz") / size).alias("nz"))
    mean = F.col("s") / n
    return sums.select(
        "feature_id", mean.alias("mean"), F.greatest(F.col("s2") / n - mean * mean, F.lit(0.0)).alias("variance"), "max", (F.col("max") / (F.col("nz") / n + 1e-6)).alias("sparsity")
    )


def top_features(stats: DataFrame, criterion: str, k: int) -> DataFrame:
    return stats.orderBy(F.desc(criterion), "feature_id").limit(k)


def _model(weights: DataFrame, decoder: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Encoder and decoder rows in order of the feature: one model, of a size that it fixes."""
    rows = weights.select("feature_id", F.col("w").alias("enc")).join(decoder.select("feature_id", F.col("w").alias("dec")), "feature_id").orderBy("feature_id").collect()
    return np.array([r["enc"] for r in rows], float), np.array([r["dec"] for r in rows], float)


def reconstruction(residues: DataFrame, weights: DataFrame, decoder: DataFrame, topk: int | None = None, digits: int = 9) -> DataFrame:
    """accession, pos, x, xhat: each residue and its decoding, multiplied where the activations are made."""
    shared = residues.sparkSession.sparkContext.broadcast(_model(weights, decoder))

    def run(batches):
        enc, dec = shared.value
        for batch in batches:
            if len(batch):
                x = np.array(batch.column(2).to_pylist(), float)
                hat = _activations(x, enc, 0.0, topk, digits) @ dec
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hat.tolist(), pa.list_(pa.float64()))], ["accession", "pos", "x", "xhat"])

    given = residues.select("accession", "pos", F.col("x").cast("array<double>").alias("x"))
    kind = {f.name: f.dataType.simpleString() for f in given.schema}
    return given.mapInArrow(run, f"accession {kind['accession']}, pos {kind['pos']}, x array<double>, xhat array<double>")


def reconstruction_metrics(residues: DataFrame, weights: DataFrame, decoder: DataFrame, topk: int | None = None, digits: int = 9) -> DataFrame:
    """One row: mse, l0, mean_abs_z, dead_share, r2; null for no rows.

    A task sends one row for each dimension (squared errors, sums, squares) and one
    for each latent (activations and their sum), whatever the number of its rows.
    """
    enc, dec = _model(weights, decoder)
    shared = residues.sparkSession.sparkContext.broadcast((enc, dec))

    def run(batches):
        enc, dec = shared.value
        dims, latents, n = np.zeros((dec.shape[1], 3)), np.zeros((len(enc), 2)), 0
        for batch in batches:
            if len(batch):
                x = np.array(batch.column(0).to_pylist(), float)
                z = _activations(x, enc, 0.0, topk, digits)
                dims += np.stack([((x - z @ dec) ** 2).sum(0), x.sum(0), (x * x).sum(0)], 1)
                latents += np.stack([(z > 0).sum(0), z.sum(0)], 1)
                n += len(x)
        if n:
            both = np.concatenate([dims, np.pad(latents, ((0, 0), (0, 1)))])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both)) - len(dims), pa.int32()), *[pa.array(c) for c in both.T.copy()], pa.array([n] * len(both), pa.int64())], ["at", "u", "v", "w", "n"])

    parts = residues.select(F.col("x").cast("array<double>").alias("x")).mapInArrow(run, "at int, u double, v double, w double, n long")
    sums = parts.groupBy("at").agg(*[F.sum(c).alias(c) for c in "uvwn"])  # a row for each dimension and latent
    dim = F.col("at") < 0
    spread_ = F.col("w") - F.col("v") * F.col("v") / F.col("n")
    return sums.agg(
        (F.sum(F.when(dim, F.col("u"))) / F.sum(F.when(dim, F.col("n")))).alias("mse"), (F.sum(F.when(~dim, F.col("u"))) / F.max("n")).alias("l0"),
        (F.sum(F.when(~dim, F.col("v"))) / (F.max("n") * len(enc))).alias("mean_abs_z"), (1 - F.count_if(~dim & (F.col("u") > 0)) / len(enc)).alias("dead_share"),
        (1 - F.sum(F.when(dim, F.col("u"))) / F.nullif(F.sum(F.when(dim, spread_)), F.lit(0.0))).alias("r2"),
    )


def pooled(residues: DataFrame) -> DataFrame:
    """Mean vector of each accession: accession, dim, v."""
    dims = residues.select("accession", F.posexplode("x").alias("dim", "v"))
    return dims.groupBy("accession", "dim").agg(F.avg(F.col("v").cast("double")).alias("v"))


def dimension_stats(residues: DataFrame, least: float = 1e-6) -> DataFrame:
    """Per dimension mean and population deviation, not below ``least``."""
    dims = residues.select(F.posexplode("x").alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    return dims.groupBy("dim").agg(F.avg("v").alias("mean"), F.greatest(F.stddev_pop("v"), F.lit(least)).alias("sd"))


def adjacent_cosine(residues: DataFrame) -> DataFrame:
    """Cosine of each residue with the next one of its protein."""
    from helixframe.functions.vectors import cosine

    own = Window.partitionBy("accession").orderBy("pos")
    pairs = residues.select("accession", "pos", "x", F.lead("x").over(own).alias("next_x"), F.lead("pos").over(own).alias("next_pos")).filter("next_pos = pos + 1")
    return pairs.select("accession", "pos", cosine("x", "next_x").alias("cosine"))
