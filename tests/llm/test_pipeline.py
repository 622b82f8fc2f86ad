"""The pipeline against brute-force versions of its stages."""

import test_decontamination
import test_line_dedup
import test_minhash
import test_packing

import corpus_pipeline
from helixframe.llm import toxicity
from helixframe.plans.staging import table


def test_stages_match_brute_force(spark, tiny):
    docs = table(spark, tiny, "documents")
    labels = table(spark, tiny, "labels").filter(~toxicity.held_out())
    scorer = toxicity.Scorer(toxicity.fit(docs, labels).collect())
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}

    rows = {d: t for d, t in rows.items() if scorer.score(t) < 0.5}
    stages = dict(corpus_pipeline.STAGES)
    out = stages["toxicity"](spark, docs, tiny)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == rows and out.columns == docs.columns

    rows = test_line_dedup.brute(sorted(rows.items()), 8)
    out = stages["line dedup"](spark, out, tiny)
    got = out.collect()
    assert {r["doc_id"]: r["text"] for r in got} == rows and out.columns == docs.columns
    assert all(r["n_chars"] == len(r["text"]) for r in got)

    kept = {d for d, _, _, keep in test_minhash.brute(list(rows.items()), width=5) if keep}
    rows = {d: t for d, t in rows.items() if d in kept}
    out = stages["near dedup"](spark, out, tiny)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == rows and out.columns == docs.columns

    items = [tuple(r) for r in table(spark, tiny, "benchmark").select("item_id", "text").collect()]
    hit = {r[0] for r in test_decontamination.brute(rows.items(), items) if r[-1]}
    rows = {d: t for d, t in rows.items() if d not in hit}
    out = stages["decontamination"](spark, out, tiny)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == rows and out.columns == docs.columns

    out = stages["packing"](spark, out, tiny).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(test_packing.brute(rows.items()))
    test_packing.check_layout(out)
    whole = corpus_pipeline.run(spark, tiny).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in out)


#: Names that the stages use themselves, or might.
CLASHING = "row kept score id version own gone_id component_id key line lines words n_kept kept_text length piece toxic item_id".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def written(spark, folder, docs, labels, benchmark):
    row = lambda d, t: (d, t, None if d == 3 else "en", None if d == 4 else "web", None if d == 5 else len(t or ""), *[f"{c}{d}" for c in CLASHING])
    spark.createDataFrame([row(*d) for d in docs], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(*r, "x") for r in benchmark], "item_id long, text string, doc_id string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def staged_results(spark, at):
    docs, out = table(spark, at, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = stage(spark, docs, at)
        assert name == "packing" or docs.columns == before
        out[name] = docs.collect()
    return out


def some(n, tag):
    return " ".join(f"{tag}{i}" for i in range(n))


EDGES = [
    (1, None), (2, ""), (3, " \n\t\n"), (4, some(60, "a")), (4, some(60, "a")), (5, "own\n" + some(60, "a")), (None, some(30, "n")), (6, some(30000, "long")),
    (7, "first " + some(40, "b")), (8, "other " + some(40, "b") + "\n" + some(9, "c")), (9, some(12, "q") + "\n" + some(12, "exam")), (9, "second text of one id"), (10, some(40, "d")), (11, some(2, "x") + " " + some(40, "d") + " end"),
]


def test_edges_of_every_stage(spark, tmp_path):
    """Nulls in any column, empty and long texts, ties, repeated rows, an id of two texts, clashing columns; labels of one class only."""
    at = written(spark, tmp_path, EDGES, [(4, None, 0), (None, 1, 1), (7, 1, None)], [(1, some(12, "exam")), (None, some(60, "a")), (2, None), (3, ""), (4, "!?")])
    out = staged_results(spark, at)
    texts = {name: sorted(((r["doc_id"], r["text"]) for r in rows), key=str) for name, rows in out.items() if name != "packing"}
    assert texts["toxicity"] == sorted(EDGES, key=str)
    lined = sorted([(d, {5: "own", 8: some(9, "c")}.get(d, t)) for d, t in EDGES], key=str)
    assert texts["line dedup"] == lined
    assert {r["doc_id"]: r["n_chars"] for r in out["line dedup"]} == {d: None if t is None else len(t) for d, t in lined}
    near = [x for x in lined if x[0] != 11]
    assert texts["near dedup"] == near
    clean = [x for x in near if x != EDGES[10]]
    assert texts["decontamination"] == clean
    pieces = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out["packing"] if r["doc_id"] is not None)
    assert pieces == sorted(test_packing.brute([x for x in clean if x[0] is not None]))
    assert sum(r["doc_id"] is None for r in out["packing"]) == 1
    assert all(r["key"] == f"key{r['doc_id']}" for r in out["decontamination"])
    test_packing.check_layout(out["packing"])


def test_empty_tables(spark, tmp_path):
    at = written(spark, tmp_path / "none", [], [], [])
    assert not any(staged_results(spark, at).values())
    at = written(spark, tmp_path / "alone", [(1, some(60, "a")), (2, None)], [], [])
    out = staged_results(spark, at)
    assert all({r["doc_id"] for r in rows} == {1, 2} for rows in out.values())
