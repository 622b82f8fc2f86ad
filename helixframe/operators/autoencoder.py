"""Sparse autoencoders trained with Spark: minibatch steps on the executors, parameters averaged between rounds.

A model has as many numbers as its two weight matrices, fixed by its shape, never
by the data.  In each round every partition starts from the broadcast parameters
and takes a step of Adam for each minibatch of its rows; the round ends with the
average of all partitions' parameters, weighted by their rows (local SGD).
Parameters travel in pieces of ``PIECE`` numbers, so a shuffle adds them up and
the driver gets one set.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.plans.staging import staged

#: Parameters in a row of the shuffle that adds them up: 32 KB.
PIECE = 4096


@dataclass(frozen=True)
class Config:
    """One architecture: vanilla, topk, matryoshka or temporal."""

    arch: str = "vanilla"
    latents: int = 32
    l1: float = 1e-3
    k: int = 8
    aux: float = 1 / 32
    temporal: float = 0.1
    temperature: float = 0.07
    rate: float = 1e-2
    epochs: int = 10
    batch: int = 2048
    rounds: int = 1
    warmup: int = 0
    anneal: int = 0
    clip: float = 1.0
    patience: int = 5
    resample_above: float = 0.05
    target_l0: float | None = None
    seed: int = 42


#: Mean activation from which on a latent is alive in an epoch.
ALIVE = 1e-3


@dataclass
class Model:
    config: Config
    w_enc: np.ndarray
    b_enc: np.ndarray
    w_dec: np.ndarray
    b_dec: np.ndarray
    log: list[dict] = field(default_factory=list)
    state: list[np.ndarray] | None = None
    steps: float = 0.0
    #: Which latents were active in any round so far.
    ever: np.ndarray | None = None

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.w_enc, self.b_enc, self.w_dec, self.b_dec]

    @property
    def moments(self) -> list[np.ndarray]:
        """Adam's means of the gradients, then of their squares."""
        if self.state is None:
            self.state = [np.zeros_like(p) for _ in range(2) for p in self.parts]
        return self.state

    def copy(self) -> Model:
        return Model(self.config, *[p.copy() for p in self.parts], list(self.log), [m.copy() for m in self.moments], self.steps, None if self.ever is None else self.ever.copy())


def initial(config: Config, dim: int) -> Model:
    """Unit decoder rows, the encoder tied to them."""
    w = np.random.default_rng(config.seed).normal(size=(config.latents, dim))
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    return Model(config, w.copy(), np.zeros(config.latents), w, np.zeros(dim))


def scales(config: Config) -> list[tuple[int, float]]:
    """(latents, weight) of the nested models of a matryoshka; one of all latents else."""
    if config.arch != "matryoshka":
        return [(config.latents, 1.0)]
    sizes = [max(1, config.latents // d) for d in (8, 4, 2, 1)]
    weights = [1 / (i + 1) for i in range(len(sizes))]
    return [(n, w / sum(weights)) for n, w in zip(sizes, weights, strict=True)]


def gate(pre: np.ndarray, config: Config, k: int | None = None) -> np.ndarray:
    """Activations from the encoder's output."""
    z = np.maximum(pre, 0)
    k = config.k if k is None else k
    if config.arch == "topk" and k < z.shape[1]:
        cut = np.partition(z, -k, axis=1)[:, -k][:, None]
        z = np.where((z >= cut) & (z > 0), z, 0.0)
    return z


def step_l1(config: Config, epoch: int) -> float:
    """The sparsity weight, rising over the warm-up epochs."""
    return config.l1 * min(1.0, (epoch + 1) / config.warmup) if config.warmup else config.l1


def step_k(config: Config, epoch: int) -> int:
    """The number of active latents, falling from all to k over the annealing epochs."""
    if not config.anneal or epoch >= config.anneal:
        return config.k
    return max(config.k, round(config.latents - (config.latents - config.k) * (epoch + 1) / config.anneal))


def adapted_l1(l1: float, l0: float, target: float, healthy: bool = True) -> float:
    """The sparsity weight moved toward a target of active latents: by the root of the ratio, between a third and twice, halved if the model is unwell."""
    factor = min(2.0, max(0.33, math.sqrt(max(l0, 1e-9) / target))) if healthy else 0.5
    return min(1e-1, max(1e-7, l1 * factor))


def neighbours(z: np.ndarray, following: np.ndarray, temperature: float) -> tuple[float, np.ndarray]:
    """How badly each row's activations tell its successor from the other rows of its protein, and the gradient.

    The mean over the pairs of a protein, then over proteins of two rows or more.
    """
    norm = np.linalg.norm(z, axis=1, keepdims=True) + 1e-8
    u = z / norm
    du, loss = np.zeros_like(u), 0.0
    ends = np.flatnonzero(following < 0) + 1
    spans = [(a, b) for a, b in zip([0, *ends[:-1]], ends, strict=True) if b - a > 1]
    for start, end in spans:
        a, b = u[start : end - 1], u[start + 1 : end]
        logits = a @ b.T / temperature
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        share = 1 / (len(a) * len(spans))
        loss -= share * float(np.log(np.diag(p) + 1e-12).sum())
        d = share * (p - np.eye(len(a))) / temperature
        du[start : end - 1] += d @ b
        du[start + 1 : end] += d.T @ a
    return loss, (du - u * (du * u).sum(1, keepdims=True)) / norm


def gradients(x: np.ndarray, following: np.ndarray, model: Model, epoch: int) -> tuple[list[np.ndarray], dict]:
    """Summed gradients and sums for the metrics over rows; ``following`` is the row's successor in its protein, or -1."""
    c = model.config
    k = step_k(c, epoch)
    pre = x @ model.w_enc.T + model.b_enc
    z = gate(pre, c, k)
    dz = np.zeros_like(z)
    g_dec, g_bias, loss = np.zeros_like(model.w_dec), np.zeros_like(model.b_dec), 0.0
    for n, weight in scales(c):
        error = z[:, :n] @ model.w_dec[:n] + model.b_dec - x
        if n == c.latents:
            whole = error
        loss += weight * float((error**2).sum())
        back = 2 * weight * error
        dz[:, :n] += back @ model.w_dec[:n].T
        g_dec[:n] += z[:, :n].T @ back
        g_bias += back.sum(0)
    if c.arch == "topk" and c.aux:
        # latents that are not among the row's active ones explain what is left
        rest = np.where(z > 0, 0.0, np.maximum(pre, 0))
        m = min(c.k, rest.shape[1])
        cut = np.partition(rest, -m, axis=1)[:, -m][:, None]
        rest = np.where((rest >= cut) & (rest > 0), rest, 0.0)
        left = rest @ model.w_dec + whole
        back = 2 * c.aux * left
        loss += c.aux * float((left**2).sum())
        g_dec += rest.T @ back
        daux = (back @ model.w_dec.T) * (rest > 0)
    else:
        daux = 0.0
        dz += step_l1(c, epoch)
        loss += step_l1(c, epoch) * float(z.sum())
    if c.arch == "temporal":
        contrast, d = neighbours(z, following, c.temperature)
        loss += c.temporal * len(x) * contrast  # the other sums are divided by the rows later
        dz += c.temporal * len(x) * d
    dpre = dz * (z > 0) + daux
    sums = {"n": len(x), "loss": loss, "sse": float((whole**2).sum()), "sx": x.sum(0), "sxx": float((x**2).sum()), "l0": int((z > 0).sum()), "used": (z > 0).sum(0), "acts": z.sum(0)}
    return [dpre.T @ x, dpre.sum(0), g_dec, g_bias], sums


def batches(frames: Iterator[pd.DataFrame], size: int, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, successors) of about ``size`` rows, whatever the frames; with ``whole`` no protein is cut, and one alone may exceed it.

    A row's successor is the next position of its protein, or -1.  The frames come
    sorted by accession and position.
    """
    left: pd.DataFrame | None = None
    done = False
    while not done:
        frame = next(frames, None)
        done = frame is None
        if frame is not None:
            left = frame if left is None or not len(left) else pd.concat([left, frame], ignore_index=True)
        at = 0
        while left is not None and at < len(left):
            keys = left["accession"].to_numpy()
            end = min(at + size, len(left))
            if whole:
                changes = np.flatnonzero(keys[1:] != keys[:-1]) + 1
                ends = [*changes[changes > at], *([len(left)] if done else [])]
                fitting = [e for e in ends if e <= at + size]
                if not ends or (len(left) - at <= size and not done):
                    break
                end = fitting[-1] if fitting else ends[0]
            elif len(left) - at < size and not done:
                break
            rows = left.iloc[at:end]
            keys, pos = rows["accession"].to_numpy(), rows["pos"].to_numpy()
            same = (keys[:-1] == keys[1:]) & (np.diff(pos) == 1)
            yield np.stack(rows["x"].to_numpy()).astype(float), np.append(np.where(same, np.arange(1, len(rows)), -1), -1)
            at = end
        if left is not None:
            left = left.iloc[at:].reset_index(drop=True)


def step(model: Model, grads: list[np.ndarray], n: int) -> None:
    """One step of Adam along the mean gradient over ``n`` rows, clipped; decoder rows stay of length one."""
    c = model.config
    norm = math.sqrt(sum(float((g**2).sum()) for g in grads)) / n
    scale = min(1.0, c.clip / (norm + 1e-12)) / n
    model.steps += 1
    m, v = model.moments[:4], model.moments[4:]
    for p, g, first, second in zip(model.parts, grads, m, v, strict=True):
        first += 0.1 * (g * scale - first)
        second += 0.001 * ((g * scale) ** 2 - second)
        p -= c.rate * (first / (1 - 0.9**model.steps)) / (np.sqrt(second / (1 - 0.999**model.steps)) + 1e-8)
    model.w_dec /= np.linalg.norm(model.w_dec, axis=1, keepdims=True) + 1e-8


def _sums(total: dict | None, own: dict) -> dict:
    return own if total is None else {k: total[k] + own[k] for k in own}


def _partial(frames, shared, epoch: int, learn: bool):
    model, sums = shared.value.copy(), None
    for x, following in batches(iter(frames), model.config.batch, model.config.arch == "temporal"):
        grads, own = gradients(x, following, model, epoch)
        sums = _sums(sums, own)
        if learn:
            step(model, grads, len(x))
    if sums is not None:
        n = sums["n"]
        weighted = [n * p.ravel() for p in [*model.parts, *model.moments]] + [[n * model.steps]] if learn else []
        flat = np.concatenate([*weighted, sums["sx"], sums["used"].astype(float), sums["acts"], [float(sums[k]) for k in ("n", "loss", "sse", "sxx", "l0")]])
        yield _pieces(flat)


def _pieces(flat: np.ndarray) -> pd.DataFrame:
    cut = [flat[i : i + PIECE].tobytes() for i in range(0, len(flat), PIECE)]
    return pd.DataFrame({"piece": np.arange(len(cut), dtype=np.int32), "v": cut})


def _added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for frame in frames:
        for piece, v in zip(frame["piece"], frame["v"], strict=True):
            own = np.frombuffer(v)
            total[piece] = total[piece] + own if piece in total else own
    if total:
        yield pd.DataFrame({"piece": np.array(list(total), dtype=np.int32), "v": [v.tobytes() for v in total.values()]})


def _pass(residues: DataFrame, model: Model, epoch: int, learn: bool) -> tuple[Model, dict | None]:
    """The model after a round over ``residues`` (the same one unless it learns) and the sums of what was seen on the way; none without rows."""
    shared = residues.sparkSession.sparkContext.broadcast(model)
    parts = residues.select("accession", "pos", "x").mapInPandas(lambda f: _partial(f, shared, epoch, learn), "piece int, v binary")
    rows = sorted(parts.repartition("piece").mapInPandas(_added, "piece int, v binary").collect())  # one set of parameters
    shared.destroy()
    if not rows:
        return model, None
    flat = np.concatenate([np.frombuffer(r["v"]) for r in rows])
    d, n = model.b_dec.size, model.config.latents
    sx, used, acts, (count, loss, sse, sxx, l0) = np.split(flat[-(d + 2 * n + 5) :], [d, d + n, d + 2 * n])
    if learn:
        out, at = [], 0
        for p in [*model.parts, *model.moments]:
            out.append(flat[at : at + p.size].reshape(p.shape) / count)
            at += p.size
        model = Model(model.config, *out[:4], model.log, out[4:], float(flat[at] / count), model.ever)
        model.w_dec /= np.linalg.norm(model.w_dec, axis=1, keepdims=True) + 1e-8
    return model, {"n": count, "loss": loss, "sse": sse, "sx": sx, "sxx": sxx, "l0": l0, "used": used, "acts": acts}


def metrics(sums: dict) -> dict:
    """Means over the rows behind ``sums``."""
    count, d = sums["n"], sums["sx"].size
    var = sums["sxx"] - (sums["sx"] ** 2).sum() / count
    means = {"loss": sums["loss"] / count, "mse": sums["sse"] / count / d, "r2": 1 - sums["sse"] / var if var > 0 else 0.0, "l0": sums["l0"] / count, "dead_frac": (sums["used"] == 0).mean(), "alive_frac": (sums["acts"] / count >= ALIVE).mean()}
    return {k: float(v) for k, v in means.items()}


def resampled(model: Model, used: np.ndarray, residues: DataFrame) -> Model:
    """Dead latents pointed at rows, the same ones each time; only where the penalty starves them."""
    dead = np.flatnonzero(used == 0)
    if model.config.arch == "topk" or len(dead) <= model.config.resample_above * len(used):
        return model
    rows = residues.orderBy(F.xxhash64("accession", "pos", F.lit(len(model.log)))).limit(len(dead)).select("x").collect()
    for k, r in zip(dead, rows, strict=False):
        v = np.array(r["x"]) - model.b_dec
        v /= np.linalg.norm(v) + 1e-8
        model.w_dec[k], model.w_enc[k], model.b_enc[k] = v, 0.2 * v, 0.0
    return model


def _dealt(residues: DataFrame, config: Config) -> DataFrame:
    """Rows spread over the tasks in a stated order: by protein where a loss compares the rows of one, else by row."""
    keys = _keys(config)
    return staged(residues.select("accession", "pos", "x").repartition(*keys).sortWithinPartitions("accession", "pos"))


def _keys(config: Config) -> list[str]:
    return ["accession"] if config.arch == "temporal" else ["accession", "pos"]


def train(residues: DataFrame, config: Config, validation: DataFrame | None = None, folder: str | None = None) -> Model | None:
    """The model of the epoch with the best R2 (on ``validation`` if given); none without rows.

    An epoch is ``rounds`` rounds, each over the rows that a hash gives it, and a
    round is a step for each minibatch of a partition.  The temporal architecture
    keeps a protein's rows in one task, so it needs proteins of bounded length.  With a ``folder`` the last
    and the best model are saved after each epoch, and training goes on from there.
    """
    rows = _dealt(residues, config)
    held_out = None if validation is None else _dealt(validation, config)
    first = rows.first()
    if first is None:
        return None
    last = load(residues.sparkSession, f"{folder}/last") if folder else None
    model = last or initial(config, len(first["x"]))
    best = (load(residues.sparkSession, f"{folder}/best") if last else None) or model
    score = max((e["val_r2"] for e in model.log), default=-math.inf)
    for epoch in range(len(model.log), config.epochs):
        if waited(model.log, config) >= config.patience:
            break
        sums = None
        for turn in range(config.rounds):
            some = rows if config.rounds == 1 else rows.filter(F.pmod(F.xxhash64(*_keys(config), F.lit(epoch)), F.lit(config.rounds)) == turn)
            model, own = _pass(some, model, epoch, learn=True)
            sums = sums if own is None else _sums(sums, own)
        seen = metrics(sums)
        active = sums["used"] > 0
        model.ever = active if model.ever is None else model.ever | active
        checked = None if held_out is None else _pass(held_out, model, epoch, learn=False)[1]
        checked = seen if checked is None else metrics(checked)
        model.log.append({"epoch": epoch, **{k: seen[k] for k in ("loss", "mse", "l0", "dead_frac", "alive_frac")}, "ever_active_frac": float(model.ever.mean()), "val_mse": checked["mse"], "val_r2": checked["r2"], "l1": model.config.l1})
        better = checked["r2"] > score
        if better:
            score, best = checked["r2"], model.copy()
        best.log = model.log
        model = resampled(model, sums["used"], rows)
        if config.target_l0:
            model.config = replace(model.config, l1=adapted_l1(model.config.l1, seen["l0"], config.target_l0, seen["dead_frac"] < 0.5))
        if folder:
            save(residues.sparkSession, model, f"{folder}/last", epoch)
            if better:
                save(residues.sparkSession, best, f"{folder}/best", epoch)
    return best


def waited(log: list[dict], config: Config) -> int:
    """Epochs since the best one, those of the warm-up left out."""
    if not log:
        return 0
    scores = [e["val_r2"] for e in log]
    return len(log) - max(scores.index(max(scores)) + 1, config.warmup)


def save(spark: SparkSession, model: Model, folder: str, epoch: int) -> None:
    """The model under a numbered folder of ``folder``; a committed one is never written over."""
    parts = [*model.parts, *model.moments]
    rows = [(i, list(p.shape), p.astype(float).tobytes()) for i, p in enumerate(parts)]
    about = json.dumps({"config": asdict(model.config), "log": model.log, "steps": model.steps, "ever": None if model.ever is None else np.packbits(model.ever).tobytes().hex()})
    spark.createDataFrame([*rows, (len(parts), [], about.encode())], "part int, shape array<int>, v binary").write.mode("ignore").parquet(f"{folder}/epoch={epoch}")


def load(spark: SparkSession, folder: str) -> Model | None:
    """The model of the last epoch saved under ``folder``; none if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/epoch=*/_SUCCESS")) or []
    epochs = [int(f.getPath().getParent().getName().removeprefix("epoch=")) for f in done]
    if not epochs:
        return None
    rows = spark.read.parquet(f"{folder}/epoch={max(epochs)}").orderBy("part").collect()
    *parts, about = [(r["shape"], r["v"]) for r in rows]
    arrays = [np.frombuffer(v).reshape(shape).copy() for shape, v in parts]
    known = json.loads(about[1].decode())
    config, ever = Config(**known["config"]), known.get("ever")
    bits = None if ever is None else np.unpackbits(np.frombuffer(bytes.fromhex(ever), np.uint8), count=config.latents).astype(bool)
    return Model(config, *arrays[:4], known["log"], arrays[4:], known["steps"], bits)


def weight_table(spark: SparkSession, model: Model) -> DataFrame:
    """feature_id, w (encoder), b, w_dec."""
    rows = [(k, model.w_enc[k].tolist(), float(model.b_enc[k]), model.w_dec[k].tolist()) for k in range(model.config.latents)]
    return spark.createDataFrame(rows, "feature_id long, w array<double>, b double, w_dec array<double>")


def fan_out(residues: DataFrame, archs: list[str], base: Config, validation: DataFrame | None = None) -> dict[str, Model | None]:
    """One model of each architecture with the same settings."""
    return {a: train(residues, replace(base, arch=a), validation) for a in archs}
