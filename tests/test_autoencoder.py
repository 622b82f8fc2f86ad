from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from helixframe.operators import autoencoder as S
from helixframe.operators import encoding
from helixframe.plans import bindings as B
from helixframe.sources.providers import provided


@pytest.mark.parametrize("arch", ["vanilla", "topk", "matryoshka", "temporal"])
def test_gradients(arch):
    """Against differences of the loss."""
    rng = np.random.default_rng(3)
    config = S.Config(arch=arch, latents=8, k=3, l1=0.05, aux=0.0 if arch == "topk" else 0.1)
    model = S.initial(config, 5)
    model.b_enc += 0.1
    x = rng.normal(size=(6, 5))
    following = np.array([1, 2, -1, 4, 5, -1])
    grads, _ = S.gradients(x, following, model, 0)
    for p, g in zip(model.parts, grads, strict=True):
        for at in [tuple(rng.integers(0, n) for n in p.shape) for _ in range(6)]:
            old, h = p[at], 1e-6
            p[at] = old + h
            up = S.gradients(x, following, model, 0)[1]["loss"]
            p[at] = old - h
            down = S.gradients(x, following, model, 0)[1]["loss"]
            p[at] = old
            assert abs((up - down) / (2 * h) - g[at]) < 1e-3 * max(1, abs(g[at]))


def test_schedules():
    c = S.Config(l1=0.1, warmup=4, anneal=3, latents=32, k=8)
    assert [round(S.step_l1(c, e), 3) for e in (0, 1, 3, 9)] == [0.025, 0.05, 0.1, 0.1]
    assert [S.step_k(c, e) for e in (0, 1, 2, 3)] == [24, 16, 8, 8]
    assert abs(S.adapted_l1(1e-3, 829.8, 512) - 1.273068e-3) < 1e-9
    assert S.adapted_l1(1e-3, 1e9, 1) == 2e-3 and S.adapted_l1(1e-3, 0.0, 512) == 3.3e-4 and S.adapted_l1(1e-3, 5, 1, healthy=False) == 5e-4 and S.adapted_l1(0.09, 1e9, 1) == 0.1
    assert [n for n, _ in S.scales(S.Config(arch="matryoshka", latents=32))] == [4, 8, 16, 32]


def test_training_improves_and_encodes(spark, tiny):
    residues = B.residues(spark, tiny)
    models = S.fan_out(residues, ["vanilla", "topk"], S.Config(latents=16, k=4, epochs=6, rate=0.02))
    for model in models.values():
        assert model.log[-1]["mse"] < model.log[0]["mse"] and len(model.log) == 6
        assert np.allclose(np.linalg.norm(model.w_dec, axis=1), 1, atol=1e-6)
    weights = S.weight_table(spark, models["topk"])
    active = encoding.encode(residues, weights, topk=4, bias=True)
    assert active.groupBy("accession", "pos").count().agg({"count": "max"}).first()[0] <= 4


def test_batches_do_not_depend_on_frames():
    rows = pd.DataFrame({"accession": [k for k, n in enumerate((3, 1, 9, 2, 2, 4)) for _ in range(n)]})
    rows["pos"] = rows.groupby("accession").cumcount() + 1
    rows["x"] = [np.array([float(i)]) for i in range(len(rows))]
    for whole, sizes in ((False, [5, 5, 5, 5, 1]), (True, [4, 9, 4, 4])):
        for cut in (1, 2, 7, 50):
            frames = [rows.iloc[i : i + cut].reset_index(drop=True) for i in range(0, len(rows), cut)]
            got = list(S.batches(iter([rows.iloc[:0], *frames]), 5, whole))
            assert [len(x) for x, _ in got] == sizes and np.concatenate([x for x, _ in got]).ravel().tolist() == list(range(21))
        if whole:  # every pair of neighbours is in some batch
            assert sum((f >= 0).sum() for _, f in got) == 21 - 6


def test_a_round_is_the_same_in_one_task_and_by_hand(spark, tiny):
    residues = B.residues(spark, tiny).coalesce(1).sortWithinPartitions("accession", "pos")
    config = S.Config(arch="temporal", latents=8, batch=30)
    model, hand = S.initial(config, 64), S.initial(config, 64)
    got, sums = S._pass(residues, model, 0, learn=True)
    for x, following in S.batches(iter([residues.toPandas()]), 30, True):
        S.step(hand, S.gradients(x, following, hand, 0)[0], len(x))
    assert all(np.allclose(a, b) for a, b in zip(got.parts, hand.parts, strict=True)) and sums["n"] == residues.count() and got.steps == hand.steps > 3


def test_rounds_cover_every_row_and_training_resumes(spark, tiny, tmp_path):
    residues = B.residues(spark, tiny)
    base = S.Config(arch="topk", latents=16, k=4, epochs=4, rate=0.02, batch=16, rounds=2)
    whole = S.train(residues, base, folder=str(tmp_path / "whole"))
    S.train(residues, replace(base, epochs=2), folder=str(tmp_path / "cut"))
    resumed = S.train(residues, base, folder=str(tmp_path / "cut"))
    assert [round(e["loss"], 6) for e in resumed.log] == [round(e["loss"], 6) for e in whole.log] and len(whole.log) == 4
    assert all(np.allclose(a, b) for a, b in zip(whole.parts, resumed.parts, strict=True))
    ever = [e["ever_active_frac"] for e in whole.log]
    assert ever == sorted(ever) and ever[-1] >= 1 - whole.log[-1]["dead_frac"] and [e["ever_active_frac"] for e in resumed.log] == ever
    saved = S.load(spark, str(tmp_path / "cut" / "last"))
    assert saved.ever.dtype == bool and saved.ever.mean() == ever[-1]
    assert all(e["alive_frac"] <= 1 - e["dead_frac"] for e in whole.log)
    assert S.load(spark, str(tmp_path / "none")) is None
    assert S.train(residues.limit(0), base) is None


def test_waited():
    log = [{"val_r2": r} for r in (0.1, 0.3, 0.2, 0.2)]
    assert S.waited(log, S.Config()) == 2 and S.waited(log, S.Config(warmup=3)) == 1 and S.waited([], S.Config()) == 0


def test_providers_isolate_errors(spark):
    def make():
        def provider(texts):
            if any("!" in t for t in texts):
                raise RuntimeError("no")
            return [np.array([[ord(c), 1.0] for c in t]) for t in texts]

        return provider

    df = spark.createDataFrame([("a", "AB"), ("b", "C!"), ("c", ""), ("d", None), ("e", "DEFG")], "accession string, sequence string")
    rows = provided(df, make, longest=3).collect()
    good = {(r["accession"], r["pos"]): list(r["x"]) for r in rows if r["error"] is None}
    assert good == {("a", 1): [65.0, 1.0], ("a", 2): [66.0, 1.0], ("e", 1): [68.0, 1.0], ("e", 2): [69.0, 1.0], ("e", 3): [70.0, 1.0]}
    assert [(r["accession"], r["error"]) for r in rows if r["error"]] == [("b", "RuntimeError: no")]
