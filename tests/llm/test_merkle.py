import zlib
from hashlib import sha256

import duckdb
import pytest

from helixframe.llm import merkle
from helixframe.llm.queries import ORACLE_SQL, op12_merkle
from helixframe.plans.staging import table

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, root string"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(hashes):
    """The levels of a tree, from the leaves on."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def beside(levels, place):
    for level in levels[:-1]:
        run = level[place // 3 * 3 : place // 3 * 3 + 3]
        yield place % 3, run
        place //= 3


def brute(rows, tampered):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r), leaf(tampered(r))))
        trees[name] = climb([leaf(r) for r in groups[name]])
    over = climb([trees[name][-1][0] for name in names])
    out = []
    for g, name in enumerate(names):
        for place, row in enumerate(groups[name]):
            way = [*beside(trees[name], place), *beside(over, g)]
            folded = leaf(tampered(row))
            for at, run in way:
                folded = digest(*run[:at], folded, *run[at + 1 :])
            proof = digest(*[h for at, run in way for k, h in enumerate(run) if k != at])
            out.append((row[0], leaf(row), trees[name][-1][0], over[-1][0], proof, folded, folded == over[-1][0]))
    return out


def without_line_ends(row):
    if row[0] is None or zlib.crc32(str(row[0]).encode()) % 2 or row[4] is None:
        return row
    return (*row[:4], row[4].replace("\n", ""))


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_whole_table(spark, tiny):
    rows = [tuple(r) for r in table(spark, tiny, "documents").select(*FIELDS).collect()]
    got = [tuple(r) for r in op12_merkle(spark, tiny).select(*COLUMNS).collect()]
    assert ordered(got) == ordered(brute(rows, without_line_ends))
    assert {r[-1] for r in got} == {True, False}


def test_twin(spark, tiny):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tiny}/documents.parquet'")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE_SQL['op12_merkle']})").fetchall()
    assert ordered(op12_merkle(spark, tiny).select(*COLUMNS).collect()) == ordered(want)


def changed_of(spark, rows):
    from pyspark.sql import functions as F

    found = merkle.manifest(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA), FIELDS, changed={"text": F.translate("text", "\n", "")})
    return [tuple(r) for r in found.select(*COLUMNS).collect()]


def no_line_ends(row):
    return (*row[:4], row[4] and row[4].replace("\n", ""))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_shapes(spark, n):
    """A lone leaf, full and ragged runs, one group and several, one of them with most rows."""
    for sources in (["a"], [None, "b", "a", "é", "z"]):
        rows = [(i, sources[i % len(sources)] if i < 2 * len(sources) else sources[0], "en", i, f"t{i}" + "\n" * (i % 2)) for i in range(n)]
        assert ordered(changed_of(spark, rows)) == ordered(brute(rows, no_line_ends))


def test_edges(spark):
    rows = [
        (1, "a", "en", 3, "x\ny"), (1, "a", "en", 3, "x\ny"), (1, "a", "en", 3, "xy"), (None, "a", None, None, None), (None, None, None, None, None), (None, None, None, None, None),
        (2, "", "de", 0, ""), (3, "a", "en", 1, "é" * 200_000 + "\n"), (-4, "a", "en", 1, "-"), (5, "-", "1:", 1, "1:a"),
    ]
    got = changed_of(spark, rows)
    assert ordered(got) == ordered(brute(rows, no_line_ends))
    assert len(got) == len(rows)


def test_deeper_than_the_cut(spark):
    """Supersteps until lineage is cut, in a group of most rows."""
    rows = [(i, "hot" if i % 50 else f"s{i}", "en", 1, f"{i}\n" if i % 3 == 0 else "") for i in range(7000)]
    assert ordered(changed_of(spark, rows)) == ordered(brute(rows, no_line_ends))


def test_verified_rows(spark):
    rows = [(i, "a", "en", 1, f"text {i}", 1, "x") for i in range(5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    proofs = merkle.manifest(docs, FIELDS)
    other = spark.createDataFrame([*rows[:4], (4, "a", "en", 1, "another", 1, "x"), (9, "a", "en", 1, "text 1", 1, "x")], SCHEMA)
    assert {(r["doc_id"], r["verified"]) for r in merkle.verified(other, proofs, FIELDS).collect()} == {(0, True), (1, True), (2, True), (3, True), (4, False), (9, False)}


def test_empty(spark):
    found = merkle.manifest(spark.createDataFrame([], SCHEMA), FIELDS)
    assert found.count() == 0 and set(COLUMNS) <= set(found.columns)
