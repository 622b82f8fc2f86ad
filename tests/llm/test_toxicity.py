import random

import numpy as np
import pytest

from helixframe.llm import toxicity
from helixframe.llm.queries import op5_toxicity
from helixframe.plans.staging import staged


def auc(pairs):
    pairs = sorted(pairs)
    n1 = sum(y for _, y in pairs)
    n0 = len(pairs) - n1
    rank, total, i = 0, 0.0, 0
    while i < len(pairs):
        j = i
        while j < len(pairs) and pairs[j][0] == pairs[i][0]:
            j += 1
        total += sum(y for _, y in pairs[i:j]) * (i + 1 + j) / 2
        i = j
    return (total - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.1"
    rows = op5_toxicity(spark, at).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert auc([(r["score"], r["toxic"]) for r in rows]) > 0.94
    assert sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) > 0.98


def test_pairs_beat_single_terms(spark):
    """Toxic only with both words: no sum of single weights separates it."""
    rng = random.Random(1)
    rows = []
    for i in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        noise = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(50)}" for _ in range(12)]
        rows.append((i, " ".join([*noise, *["zorg"] * a, *["quim"] * b]), int(a == b)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 2], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    truth = {r[0]: r[2] for r in rows}
    got = toxicity.score(docs, model).filter("doc_id % 2 = 0").collect()
    assert sum((r["score"] >= 0.5) == truth[r["doc_id"]] for r in got) > 0.95 * len(got)


def test_rare_pairs_are_learned(spark):
    """An insult and a group, each in under 2 % of the documents, behind 1,500 more frequent words; toxic only together."""
    rng = random.Random(7)
    common = [f"{a}{b}{i}" for i in range(30) for a in "bcdfghjklm" for b in "aeiou"]
    rows = []
    for i in range(6000):
        kind = i % 100
        words = [rng.choice(common) for _ in range(120)]
        toxic = int(kind == 0 or kind >= 50 and kind not in (50, 51))
        words += ["zorg"] * (kind in (0, 50)) + ["quim"] * (kind in (0, 51))
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = staged(toxicity.fit(docs, labels))
    assert {t for w in (b"zorg", b"quim") for t in toxicity.word_terms(w)} <= {r["term"] for r in model.collect()}
    got = toxicity.score(docs, model).filter("doc_id % 100 in (0, 50, 51)").collect()
    assert sum((r["score"] >= 0.5) == (r["doc_id"] % 100 == 0) for r in got) > 0.95 * len(got)


def test_best_pairs_match_brute_force():
    rng = np.random.default_rng(3)
    present = rng.random((300, 40)) < rng.random(40)
    present[:, 7] = present[:, 3]
    y = (rng.random(300) < np.where(present[:, 1] ^ present[:, 2], 0.9, 0.2)).astype(float)
    n1, n0 = y.sum(), (1 - y).sum()
    alone = toxicity._g(present[y == 1].sum(0).astype(float), present[y == 0].sum(0).astype(float), n1, n0)
    rows = [np.flatnonzero(r) for r in present]
    flat, sizes = np.concatenate(rows).astype(np.int32), np.array([len(r) for r in rows])
    got = np.max([toxicity.pair_gains(flat, sizes, y == 1, alone, n1, n0, toxicity.LEAST_G, part, 3) for part in range(3)], 0)
    first, same = toxicity._classes(np.array([[5, 1], [2, 9], [5, 1], [5, 2]]))
    assert first.tolist() == [0, 1, 3] and same.tolist() == [0, 1, 0, 2]
    for i in range(40):
        most = 0.0
        for j in set(range(40)) - {i}:
            both = present[:, i] & present[:, j]
            g = toxicity._g(float((both & (y == 1)).sum()), float((both & (y == 0)).sum()), n1, n0)
            most = max(most, g - max(alone[i], alone[j]))
        assert (got[i] >= toxicity.LEAST_G) == (most >= toxicity.LEAST_G)
        assert most < toxicity.LEAST_G or abs(got[i] - most) < 1e-9


def test_foreign_words_seldom_hit_the_model():
    """Of 400,000 words not seen, about 8192 / BUCKETS each share a term with a model of so many terms."""
    assert toxicity.MAX_ROWS == 6000
    model = [{"term": -1, "weight": 0.0, "factors": [0.0] * toxicity.FACTORS}]
    own = sorted({toxicity.word_terms(b"m%d" % i)[0] for i in range(8192)})
    scorer = toxicity.Scorer(model + [{"term": t, "weight": 1.0, "factors": [0.0] * toxicity.FACTORS} for t in own])
    assert len(scorer.terms(" ".join(f"{i:x}z" for i in range(16**5 - 400_000, 16**5)))) < 400


def test_score_and_gradients_match_plain_loops():
    rng = np.random.default_rng(2)
    words = [b"alpha", b"beta", b"gamma", b"delta"]
    terms = sorted({t for w in words for t in toxicity.word_terms(w)})
    w, v = rng.normal(size=len(terms)), rng.normal(size=(len(terms), toxicity.FACTORS)) / 3
    model = [{"term": -1, "weight": 0.3, "factors": [0.0] * toxicity.FACTORS}]
    scorer = toxicity.Scorer(model + [{"term": t, "weight": a, "factors": f} for t, a, f in zip(terms, w, v.tolist(), strict=True)])

    def plain(own, w0, w, v):
        z = w0
        for n, i in enumerate(own):
            z += w[i]
            for j in own[:n]:
                z += sum(v[i][f] * v[j][f] for f in range(toxicity.FACTORS))
        return z

    texts = ["alpha beta", "Gamma, gamma delta", "", "beta other", "alpha gamma delta"]
    rows = [sorted({terms.index(t) for x in toxicity.distinct_words(text) for t in toxicity.word_terms(x) if t in terms}) for text in texts]
    for text, own in zip(texts, rows, strict=True):
        assert scorer.score(text) == pytest.approx(1 / (1 + np.exp(-plain(own, 0.3, w, v))))
    y, share = np.array([1.0, 0, 0, 1, 0]), np.array([0.1, 0.3, 0.2, 0.2, 0.2])
    doc, term = np.repeat(np.arange(5), [len(r) for r in rows]), np.array([t for r in rows for t in r])

    def loss(w0, w, v):
        z = np.array([plain(own, w0, w, v) for own in rows])
        return (share * (np.log1p(np.exp(z)) - y * z)).sum()

    z, (g0, gw, gv) = toxicity.gradients(doc, term, y, share, np.array([0.3]), w, v)
    assert z == pytest.approx([plain(own, 0.3, w, v) for own in rows])
    e = 1e-6
    assert g0[0] == pytest.approx((loss(0.3 + e, w, v) - loss(0.3 - e, w, v)) / (2 * e), abs=1e-6)
    for i in range(0, len(terms), 3):
        step = np.zeros(len(terms))
        step[i] = e
        assert gw[i] == pytest.approx((loss(0.3, w + step, v) - loss(0.3, w - step, v)) / (2 * e), abs=1e-6)
        step = np.zeros_like(v)
        step[i, 1] = e
        assert gv[i, 1] == pytest.approx((loss(0.3, w, v + step) - loss(0.3, w, v - step)) / (2 * e), abs=1e-6)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", None), (None, "bad", 1.0), (4, "Bad " * 50000, 2.0), (4, "Bad " * 50000, 2.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, none))
    assert scored.columns == ["doc_id", "text", "score"]
    assert [round(r["score"], 6) for r in scored.collect()] == [0.0] * 5
    kept = toxicity.reject_toxic(docs, toxicity.fit(docs, none))
    assert kept.columns == docs.columns and kept.count() == 5
    assert sorted(str(r["score"]) for r in kept.collect()) == sorted(["0.5", "None", "1.0", "2.0", "2.0"])
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 1)], "doc_id long, toxic int")
    assert all(r["score"] > 0.99 for r in toxicity.score(docs, toxicity.fit(docs, odd)).collect())
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, none)).count() == 0


def test_repeated_labels_count_once(spark):
    """A label that a third of all rows repeat weighs no more than one."""
    rows = [(i, ("you fool " if i % 4 == 0 else "good day ") + f"w{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, int(i % 4 == 0)) for i, _ in rows]
    once, often = (toxicity.fit(docs, spark.createDataFrame(own, "doc_id long, toxic int")) for own in (labels, labels + [(4, 1)] * 100))
    key = lambda m: sorted((r["term"], round(r["weight"], 9)) for r in m.collect())
    assert key(once) == key(often)
