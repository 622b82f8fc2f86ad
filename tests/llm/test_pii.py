import itertools
import re
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import pii, tagger
from helixframe.llm.queries import op13_pii
from helixframe.plans.staging import staged, table

PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plainly(text):
    """Base spans by the patterns as they are written."""
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if "0" <= c <= "9"]
            doubled = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))]
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")) or kind == 2 and (not 12 <= len(digits) <= 19 or sum(doubled) % 10) or kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="0123456789.+-@ ()aZ%_é😀٣", max_size=60))
def test_patterns(text):
    assert pii.base_spans(text)[0] == plainly(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a.b@c.de", "@", "a@b", "1.2.3.4", "256.1.1.1", "001.0255.1.1", "4111 1111-1111 1111", "4111111111111112", "+1 (743) 555-3824", "+12", "12.", " ", "x", "+"]), max_size=12))
def test_patterns_of_parts(parts):
    text = "".join(parts)
    assert pii.base_spans(text)[0] == plainly(text)


def test_patterns_of_long_runs_take_time_in_proportion():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1 " * 100_000, "@" * 300_000, "a@b" * 100_000):
        pii.base_spans(text)  # quadratic, each would take minutes


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(float) + rng.normal(0, 0.1, v.shape) for k, v in tagger.created(7, 4, 5).items()}
    allowed, begins = np.ones((5, 5)), np.ones(5)
    allowed[0, 2] = 0
    ids, tags = rng.integers(0, 7, (3, 6)), rng.choice([0, 1, 3, 4], (3, 6))
    _, g = tagger.loss_and_gradients(p, ids, tags, allowed, begins)
    for name, i in [(name, i) for name in p for i in range(0, p[name].size, max(p[name].size // 9, 1))]:
        flat, value = p[name].reshape(-1), p[name].reshape(-1)[i]
        loss = []
        for step in (1e-5, -1e-5):
            flat[i] = value + step
            loss.append(tagger.loss_and_gradients(p, ids, tags, allowed, begins)[0])
        flat[i] = value
        assert g[name].reshape(-1)[i] == pytest.approx((loss[0] - loss[1]) / 2e-5, abs=1e-6)


def test_chain_against_all_taggings():
    rng = np.random.default_rng(2)
    p = {k: v.astype(float) + rng.normal(0, 0.5, v.shape) for k, v in tagger.created(5, 3, 3).items()}
    allowed, begins = np.array([[1.0, 1, 0], [1, 1, 1], [1, 1, 1]]), np.ones(3)
    ids = rng.integers(0, 5, (1, 4))
    scores = tagger._scores(p, tagger._states(p, ids, False)[0])[0][:, 0]
    total, marginals, best = 0.0, np.zeros((4, 3)), (-np.inf, None)
    for path in itertools.product(range(3), repeat=4):
        if any(not allowed[a, b] for a, b in itertools.pairwise(path)):
            continue
        value = p["first"][path[0]] + scores[range(4), path].sum() + sum(p["moves"][a, b] for a, b in itertools.pairwise(path))
        total += np.exp(value)
        marginals[range(4), path] += np.exp(value)
        best = max(best, (value, path))
    path, sure = tagger.decoded(p, ids, allowed, begins)
    assert tuple(path[0]) == best[1] and sure[0] == pytest.approx(marginals[range(4), best[1]] / total)
    assert tagger.loss_and_gradients(p, ids, path, allowed, begins)[0] == pytest.approx(np.log(total) - best[0])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab 1@", max_size=500), st.integers(0, 400), st.integers(1, 64))
def test_windows_hold_every_span(text, start, size):
    text = text.replace("1", "a", len(text) // 4)
    begins = list(pii.windows(text))
    assert begins == sorted(set(begins)) and all(pii.ANCHOR.search(text[b : b + pii.WINDOW]) for b in begins)
    if pii.ANCHOR.search(part := text[start : start + size]):
        assert any(b <= start and start + len(part) <= b + pii.WINDOW for b in begins)


def test_tags():
    own = pii.tags([(3, 6, 0), (6, 9, 1), (125, 140, 2)])
    assert own[2:10].tolist() == [0, 1, 2, 2, 3, 4, 4, 0] and own[124:].tolist() == [0, 5, 6, 6]
    assert pii.tags([(90, 110, 3)], 100)[:12].tolist() == [8] * 10 + [0, 0]
    assert pii.tags([(0, 4, 1), (2, 8, 2)])[:9].tolist() == [3, 4, 4, 4, 0, 0, 0, 0, 0]  # the earlier of two that overlap


def test_reconciled_is_the_best_set():
    rng = np.random.default_rng(4)
    for _ in range(200):
        text = "1" * 60
        found = [(int(s := rng.integers(0, 50)), int(s + rng.integers(1, 10)), 0, float(rng.uniform(0.8, 1)), False) for _ in range(7)]
        text = "1." * 30
        base, refused = [(10, 13, 2)], [(30, 33, 0), (40, 44, 1)]
        got = pii.reconciled(text, found, base, refused)
        clean = {}
        for s, e, k, sure, _ in found:
            s, e = pii._edges(text, s, e)
            if "1" in text[s:e] and "." in text[s:e] and (e <= 10 or s >= 13) and (e <= 30 or s >= 33):
                clean[s, e, k] = max(sure, clean.get((s, e, k), 0))
        # What windows found uncut stays apart; the most probable set, by trying all.
        most = max(sum(clean[s] for s in c) for r in range(len(clean) + 1) for c in itertools.combinations(clean, r) if all(a[1] <= b[0] for a, b in itertools.pairwise(sorted(c))))
        assert sum(clean[s] for s in got) == pytest.approx(most)
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(sorted(got)))


def test_parts_of_a_span_are_joined():
    text = "x " * 30 + "1" * 9 + "." + "a" * 150 + "@b.c"
    found = [(60, 128, 0, 0.95, True), (64, 192, 0, 0.9, True), (128, len(text), 0, 0.99, True)]
    assert pii.reconciled(text, found, [], []) == [(60, len(text), 0)]


@pytest.fixture(scope="module")
def model(spark):
    return staged(pii.fit(table(spark, "/root/testdata/sf0.01", "documents")))


@pytest.fixture(scope="module")
def finder(model):
    return pii.Finder(model.collect())


def test_windows_without_an_anchor_change_nothing(spark, finder, monkeypatch):
    texts = [r["text"] for r in table(spark, "/root/testdata/sf0.001", "documents").select("text").collect()]
    texts += ["write hans (at) firma (dot) de, (743) 555-3824 or 10[.]20[.]30[.]40 " * 9]
    got = list(finder.find(texts))
    monkeypatch.setattr(pii, "windows", lambda text: range(0, max(len(text) - pii.STRIDE, 1), pii.STRIDE))
    assert got == list(finder.find(texts))


def test_held_out(spark, finder):
    """Data respelled in windows that weren't learned from are found, and numbers that are none are left alone."""
    rng = np.random.default_rng(11)
    texts = [r["text"] for r in table(spark, "/root/testdata/sf0.1", "documents").filter("doc_id % 7 = 3").select("text").collect()]
    carrier = [t[:400] for t in texts if not pii.ANCHOR.search(t[:400]) and len(t) > 300][:300]
    values = [(t[s:e], k) for t in texts for s, e, k in pii.base_spans(t)[0] if k != 2 or "-" not in t[s:e]]
    hit = wrong = 0
    for i, text in enumerate(carrier):
        value, kind = values[i % len(values)]
        new = pii._respelled(value, kind, rng)
        (_, added), (_, none) = finder.find([f"{text[:200]} {new} {text[200:]}", f"{text[:200]} {pii._unlike(rng)} {text[200:]}"])
        hit += any(k == kind and s < 201 + len(new) and e > 201 for s, e, k in added)
        wrong += bool(none)
    assert len(carrier) > 100 and hit > 0.6 * len(carrier) and wrong < 0.06 * len(carrier), (hit, wrong, len(carrier))


def test_query(spark, tiny):
    got = {r["doc_id"]: r for r in op13_pii(spark, tiny).collect()}
    docs = table(spark, tiny, "documents").collect()
    assert len(got) == len(docs) and sum(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in got.values()) > 0
    for d in docs:
        r, base = got[d["doc_id"]], plainly(d["text"] or "")
        listed = [f"{pii.KINDS[k]}:{s}:{e}" for s, e, k in base]
        assert r["base_sha256"] == sha256(",".join(listed).encode()).hexdigest()
        assert [r[f"n_{kind}"] for kind in pii.KINDS] == [sum(k == i for *_, k in base) for i in range(4)]
        assert set(listed) <= set(r["spans"].split(","))


def test_edges(spark, model):
    mail = "mail hans.meier@firma.example.de or (743) 555-3824 " * 3
    rows = [(1, None, "x", 1), (None, mail, "y", 2), (3, "", None, None), (4, mail, "z", 3), (4, mail, "z", 3), (5, "a " * 200_000 + "ip 10.0.0.255, 10.0.0.256", "q", 4), (6, "😀 +1 743 555 3824 4111111111111111", "r", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string, spans int")
    got = {}
    for r in pii.find(docs, model).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == {1, None, 3, 4, 5, 6} and len(got[4]) == 2
    assert got[1][0]["base"] == got[1][0]["spans"] == got[3][0]["spans"] == []
    assert [(s["kind"], s["start"], s["end"]) for s in got[5][0]["base"]] == [("ip", 400003, 400013)]
    assert [(s["kind"], s["start"], s["end"]) for s in got[6][0]["base"]] == [(pii.KINDS[k], s, e) for s, e, k in plainly(rows[6][1])]
    clean = {r["doc_id"]: r for r in pii.redact(docs, model).collect()}
    assert clean[1]["text"] is None and clean[3]["text"] == "" and (clean[5]["base"], clean[5]["spans"]) == ("q", 4)
    assert clean[4]["text"].count("[EMAIL]") == 3 and "@" not in clean[4]["text"]
    assert clean[5]["text"].endswith("ip [IP], 10.0.0.256")


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "no data (at all)"), (2, None)], "doc_id long, text string")
    model = pii.fit(docs)
    assert model.count() == 0
    other = spark.createDataFrame([(1, "mail a@b.de, call (743) 555-3824")], docs.schema)
    assert pii.find(other, model).first()["spans"] == pii.find(other, model).first()["base"] != []


def test_empty(spark, model):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.fit(docs).count() == 0 and pii.find(docs, model).count() == 0 and pii.redact(docs, model).count() == 0
