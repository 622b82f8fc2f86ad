import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from helixframe.llm import packing
from helixframe.llm.queries import op9_packing, public_tokenizer


def brute(texts, size=2048):
    tokenizer = Tokenizer.from_str(public_tokenizer())
    for doc_id, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), size)):
            part = ids[at : at + size]
            yield doc_id, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())


def check_layout(rows, size=2048):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_query_matches_the_tokenizer(spark, tiny):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    rows = op9_packing(spark, tiny).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(brute(docs))
    n = check_layout(rows)
    assert n <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_edges(spark):
    odd = [
        (1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "Hello, world's 12 ñ", "y"), (4, "<|endoftext|> it's\t\n a", "z"), (5, "word " * 9000, None), (6, " \n ", ""),
        (7, "İstanbul, éré. x½, 5½. ... don't. DON'T, ñ'S! <|ENDOFTEXT|> <|startoftext|>A b\u00a0c e\u0301, ΑΣ. (a). a).", "q"),
    ]
    docs = spark.createDataFrame(odd, "doc_id long, text string, piece string")
    rows = packing.pack(docs, public_tokenizer()).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(brute([o[:2] for o in odd]), key=key)
    check_layout(rows)
    assert packing.pack(docs.limit(0), public_tokenizer()).count() == 0


def test_letters_that_grow_when_lower_cased():
    """Behind each the marks, alone and several, and at a word's end, in front and in the middle."""
    grown = [chr(c) for c in range(128, 0x1F000) if len(chr(c).lower()) > 1]
    assert "İ" in grown
    words = [a + x + b + m for x in [*grown, "é", "ñ", "ΑΣ"] for a in ("", "TAR", "a1") for b in ("", "ab", "B") for m in ("", *".,;:!?%*#&$|", "...", "!?", "'s", "-a")]
    texts = [" ".join(words), "TARİ. SON HALİ, bitti", *words]
    tokenizer = Tokenizer.from_str(public_tokenizer())
    assert [ids.tolist() for ids in packing._Coder(public_tokenizer()).encoded(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, "a b c " * i) for i in range(30)], "doc_id long, text string")
    packed = packing.pack(docs, public_tokenizer(), size=64, with_ids=True)
    found = packing.sequences(packed).collect()
    assert sum(len(r["ids"]) for r in found) == sum(3 * i + 1 for i in range(30))
    assert max(len(r["ids"]) for r in found) <= 64


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_best_fit(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(4, 60))
    counts = {int(n): int(rng.integers(1, 40)) for n in rng.integers(1, size + 1, 12)}
    bins = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fitting = [b for b in range(len(bins)) if bins[b] >= n]
        if not fitting:
            bins.append(size)
            fitting = [len(bins) - 1]
        bins[min(fitting, key=lambda b: bins[b])] -= n
    rows = packing.best_fit(counts, size)
    used = {}
    for n in counts:
        own = sorted(r for r in rows if r[0] == n)
        ends = [r[1] for r in own[1:]] + [counts[n]]
        for (_, first, seqs, sequence, offset), end in zip(own, ends, strict=True):
            for k in range(end - first):
                used.setdefault(sequence + k % seqs, []).append((offset + k // seqs * n, n))
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= size
    assert len(used) == len(bins)


def test_what_is_forgotten_is_encoded_again(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 4000)
    coder = packing._Coder(public_tokenizer())
    tokenizer = Tokenizer.from_str(public_tokenizer())
    for i in range(60):
        texts = [f"Word{i}a, common words. x{i * j} ñu{j}" for j in range(4)] + [None, "", "common, " * 50]
        assert [c.tolist() for c in coder.encoded(texts)] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert coder.bytes < 20_000


def test_rows_of_one_id_are_ranked_apart(spark):
    docs = spark.createDataFrame([(None, f"w{i} " * 3) for i in range(200)], "doc_id long, text string")
    check_layout(packing.pack(docs, public_tokenizer(), size=16).collect(), 16)
