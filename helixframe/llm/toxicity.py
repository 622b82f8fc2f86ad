"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct words and their prefixes of a few lengths,
hashed.  Terms that go with the label (a G test over the fitting rows), alone or
in a pair (by more, as a term is in many pairs), enter a second-order factorization machine: a weight for each term and
a vector, whose products weigh pairs such as an insult and a group that it is said
of.  All pairs of terms are counted over all fitting rows, except those in too few
rows to pass the test whatever their labels; every term that passes is learned.

The machine is fitted on a bounded sample of labelled rows (``MAX_ROWS`` of each
class, by hash of the id, weighted back to the classes' shares).  Terms are read
and counted, and pairs tested, over many tasks; the machine itself is fitted in
one, over the terms that passed.  Scoring runs over all rows with the broadcast
model, whose size the sample bounds: a term takes several of its rows.

Copies of a text among the fitting rows are one row of all their weight.

Defined results: a null or empty text has no terms and gets the score of the
constant; rows with null labels or ids are not learned from, and repeated labels count
once; of rows equal in id, each is learned from with each of the id's labels; with no labelled rows of one
class, as in empty tables, every score is the share of the other (0 without any);
a text is read whole, whatever its length; columns besides id, text and label are
carried through, but for one named like the score, which is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.memory import Remembered, forget, held
from helixframe.plans.staging import spread, staged

#: Labelled rows of each class in the fitting sample, about.
MAX_ROWS = 6000
#: Least G statistic of a term in the model (chi-square with one degree of freedom).
LEAST_G = 18.0
PREFIXES = (4, 5, 6)
FACTORS = 8
#: Decay of weights and of factors.
DECAY_W, DECAY_V = 1e-4, 1e-3
BUCKETS = 2**26
#: Bytes of words and their terms that a worker remembers.
REMEMBERED = 60_000_000

_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_terms(word: bytes) -> list[int]:
    """The hashed terms of one word: itself and its prefixes."""
    own = word.decode(errors="replace")
    keys = {b"w" + word} | {b"p" + own[:n].encode() for n in PREFIXES if len(own) >= n}
    return [xxhash.xxh3_64_intdigest(k) % BUCKETS for k in keys]


def distinct_words(text: str | None) -> set[bytes]:
    return set((text or "").lower().encode().translate(_FOLD).split())


def _g(a, b, n1: float, n0: float):
    """The G statistic of terms that ``a`` of ``n1`` and ``b`` of ``n0`` documents have."""
    total = n1 + n0
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * sum(
            np.nan_to_num(o * np.log(o / e))
            for o, e in ((a, (a + b) * n1 / total), (b, (a + b) * n0 / total), (n1 - a, (total - a - b) * n1 / total), (n0 - b, (total - a - b) * n0 / total))
        )


def _least(n: float, pure, least: float) -> float:
    """The least number of rows, up to ``n``, of one class and none of the other with enough of G."""
    enough = np.flatnonzero(pure(np.arange(n + 1.0)) >= least)
    return enough[0] if len(enough) else np.inf


def least_rows(n1: float, n0: float, least: float = LEAST_G) -> tuple[float, float]:
    """Rows of either class that a term needs for it, or a pair with it, to reach ``least``: G is greatest for rows of one class alone."""
    return _least(n1, lambda k: _g(k, 0 * k, n1, n0), least), _least(n0, lambda k: _g(0 * k, k, n1, n0), least)


def _terms(batches):
    """Rows (rank, toxic, weight, text) with the ascending terms of the text in its place."""
    try:
        known = held("toxicity terms", lambda: Remembered(word_terms, REMEMBERED))
        for batch in batches:
            rows = [sorted(set().union(*map(known.__getitem__, distinct_words(t.as_py())))) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, pa.list_(pa.int32()))], ["rank", "toxic", "weight", "terms"])
    finally:
        forget()


def _numbered(own: pa.ListScalar, ids: np.ndarray) -> np.ndarray:
    """The places of ascending terms in ``ids``, of those that are there."""
    own = own.values.to_numpy() if own.values is not None else np.zeros(0, np.int32)
    if not len(ids):
        return np.zeros(0, np.int32)
    at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
    return at[ids[at] == own].astype(np.int32)


BLOBS = "rank binary, toxic binary, weight binary, sizes binary, flat binary"


def _blobs(batches, shared):
    """Rows (rank, toxic, weight, terms) as one row of arrays for each batch, their terms numbered by ``shared`` behind one another."""
    for batch in batches:
        rows = [_numbered(own, shared.value) for own in batch.column(3)]
        flat, sizes = np.concatenate([*rows, np.zeros(0, np.int32)]), np.array([len(r) for r in rows], np.int32)
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:3]]
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (*columns, sizes, flat)], [f.split()[0] for f in BLOBS.split(", ")])


def _arrays(blobs: list) -> list[np.ndarray]:
    """rank, toxic, weight, sizes and flat of all rows of blobs."""
    kinds = (np.int64, np.float64, np.float64, np.int32, np.int32)
    return [np.concatenate([np.frombuffer(b[i], kind) for b in blobs] + [np.zeros(0, kind)]) for i, kind in enumerate(kinds)]


def _classes(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each class of equal ``marks``, ascending, and the class of each row."""
    _, first, same = np.unique(marks, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first)
    number = np.empty(len(first), int)
    number[order] = np.arange(len(first))
    return first[order], number[same.ravel()]


def least_gain(k: int) -> float:
    """What a pair must tell beyond its terms: as one of ``k`` that its term is in, that much more than a term alone."""
    return LEAST_G + 2 * np.log(max(k, 1))


def pair_gains(flat: np.ndarray, sizes: np.ndarray, toxic: np.ndarray, alone: np.ndarray, n1: float, n0: float, bar: float, part: int = 0, parts: int = 1) -> np.ndarray:
    """For each term the most that a pair tells that neither of its two does, over the pairs of every ``parts``-th term with all behind it.

    Row r has ``sizes[r]`` ascending terms of ``flat``.  Pairs in too few rows to
    reach ``bar`` are left out.
    """
    k = len(alone)
    ends = np.cumsum(sizes)
    rows = [flat[begin:end] for begin, end in zip(ends - sizes, ends, strict=True)]
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    by_term = np.argsort(flat, kind="stable").astype(np.int32)
    holders = doc[by_term]
    behind = (np.arange(len(flat), dtype=np.int32) - (ends - sizes).astype(np.int32)[doc] + 1)[by_term]
    stops = np.cumsum(np.bincount(flat, minlength=k))
    best = np.zeros(k)
    least_a, least_b = least_rows(n1, n0, bar)
    for i in range(part, k, parts):
        own, after = holders[stops[i - 1] if i else 0 : stops[i]], behind[stops[i - 1] if i else 0 : stops[i]]
        counts = []
        for of in (toxic[own], ~toxic[own]):
            met = [rows[d][p:] for d, p in zip(own[of].tolist(), after[of].tolist(), strict=True)]
            counts.append(np.bincount(np.concatenate(met), minlength=k) if met else np.zeros(k, int))
        a, b = counts
        js = np.flatnonzero((a >= least_a) | (b >= least_b))
        if len(js):
            beyond = _g(a[js].astype(float), b[js].astype(float), n1, n0) - np.maximum(alone[i], alone[js])
            best[i] = max(best[i], beyond.max())
            best[js] = np.maximum(best[js], beyond)
    return best


def _gains(batches, shared, parts: int):
    try:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                best = pair_gains(*shared.value, part, parts)
                at = np.flatnonzero(best >= shared.value[-1])
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(best[at])], ["term", "gain"])
    finally:
        forget()


def gradients(doc: np.ndarray, term: np.ndarray, y: np.ndarray, share: np.ndarray, w0: np.ndarray, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rows' log odds, and the gradients by w0, w and v of their mean log loss, weighted by ``share``; row doc[i], ascending, has term[i]."""
    n, k = len(y), len(w)
    own, by_term = v[term], np.argsort(term, kind="stable")

    def total(x: np.ndarray, keys: np.ndarray, size: int) -> np.ndarray:
        """Sums of the rows of ``x`` by ascending keys."""
        out = np.zeros((size, *x.shape[1:]))
        if len(keys):
            begin = np.flatnonzero(np.diff(keys, prepend=-1))
            out[keys[begin]] = np.add.reduceat(x, begin)
        return out

    sums = total(own, doc, n)
    z = w0[0] + np.bincount(doc, w[term], n) + 0.5 * ((sums**2).sum(1) - np.bincount(doc, (own**2).sum(1), n))
    error = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
    pull = (sums[doc] - own) * error[doc][:, None]
    return z, [np.array([error.sum()]), np.bincount(term, error[doc], k), total(pull[by_term], term[by_term], k)]


def machine(flat: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray, k: int, seed: int = 3, epochs: int = 10, least_steps: int = 500, rate: float = 0.05, at_once: int = 64):
    """The constant, weights and factors of ``k`` terms, by AdaGrad over a few rows at once; row r has ``sizes[r]`` terms of ``flat``."""
    rng = np.random.default_rng(seed)
    n, ends = len(y), np.cumsum(sizes)
    rows = [flat[begin:end] for begin, end in zip(ends - sizes, ends, strict=True)]
    weight = weight / weight.mean()
    w0, w, v = np.array([np.log((weight * y).sum() / (weight * (1 - y)).sum())]), np.zeros(k), rng.normal(0, 0.05, (k, FACTORS))
    seen = [np.full_like(p, 1e-8) for p in (w0, w, v)]
    for _ in range(max(epochs, -(-least_steps * at_once // n))):
        order = rng.permutation(n)
        for begin in range(0, n, at_once):
            own = order[begin : begin + at_once]
            terms, term = np.unique(np.concatenate([rows[r] for r in own]), return_inverse=True)
            doc = np.repeat(np.arange(len(own)), sizes[own])
            _, (g0, gw, gv) = gradients(doc, term, y[own], weight[own] / len(own), w0, w[terms], v[terms])
            steps = ((w0, slice(None), g0), (w, terms, gw + DECAY_W * w[terms]), (v, terms, gv + DECAY_V * v[terms]))
            for (p, at, grad), past in zip(steps, seen, strict=True):
                past[at] += grad**2
                p[at] -= rate * grad / np.sqrt(past[at])
    return w0[0], w, v


MODEL = "term long, weight double, factors array<double>"


def _fitted(batches, shared):
    """The model from the blobs of all rows, whose terms are numbers of ``shared``."""
    chosen = shared.value
    rank, y, weight, sizes, flat = _arrays([[c[0].as_py() for c in b.slice(i, 1).columns] for b in batches for i in range(len(b))])
    ends = np.cumsum(sizes)
    order = np.lexsort((sizes, y, rank))  # the sums do not depend on the partitions
    flat = np.concatenate([flat[ends[r] - sizes[r] : ends[r]] for r in order])
    w0, w, v = machine(flat, sizes[order], y[order], weight[order], len(chosen))
    columns = [pa.array([-1, *chosen.tolist()], pa.int64()), pa.array([w0, *w.tolist()]), pa.array([[0.0] * FACTORS, *v.tolist()])]
    yield pa.RecordBatch.from_arrays(columns, ["term", "weight", "factors"])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """A model (term, weight, factors) from labelled documents; term -1 is the constant.

    ``labels`` holds the rows to learn from, no others.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("toxic")).dropna().filter("toxic in (0, 1)").distinct()
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    of_class = {c: min(1.0, max_rows / max(n.get(c, 0), 1)) for c in (0.0, 1.0)}
    part = F.when(F.col("toxic") == 1, of_class[1.0]).otherwise(of_class[0.0])
    rank = F.xxhash64(F.col("id").cast("string"))
    sample = known.withColumn("share", part).withColumn("rank", rank).filter(F.pmod("rank", F.lit(2**20)) < F.col("share") * 2**20)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(sample), "id").select("rank", "toxic", (1 / F.col("share")).alias("weight"), "text")  # about 2 * max_rows ids
    fields = "rank long, toxic double, weight double, terms array<int>"
    # Copies of a text tell no more than one: they are one row of all their weight.
    copies = found.mapInArrow(_terms, fields).groupBy("terms", "toxic").agg(F.min("rank").alias("rank"), F.sum("weight").alias("weight"))
    # Two hashes of a row: summed up by term, they tell terms in the same rows.
    marks = F.xxhash64("rank", "toxic", "terms").alias("m1"), F.xxhash64("terms", "rank").alias("m2")
    rows = staged(copies.select("rank", "toxic", "weight", "terms", *marks))

    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1.0, 0), n.get(0.0, 0)
    if not n1 or not n0:
        return spark.createDataFrame([(-1, 20.0 if n1 else -20.0, [0.0] * FACTORS)], MODEL)
    least_a, least_b = map(float, least_rows(n1, n0))
    counted = rows.select("toxic", "m1", "m2", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"), F.bit_xor("m1").alias("m1"), F.bit_xor("m2").alias("m2"))
    # Each takes several rows of the sample, which so bounds their number.
    able = counted.filter((F.col("a") >= least_a) | (F.col("n") - F.col("a") >= least_b)).orderBy("term").collect()
    ids, a, n = np.array([r["term"] for r in able], np.int32), np.array([r["a"] for r in able], float), np.array([r["n"] for r in able], float)
    score = _g(a, n - a, n1, n0)
    passed = score >= LEAST_G
    # A pair has no more rows than its terms; terms in the same rows have the same pairs, and one stands for all.
    bar = least_gain(len(ids))
    least_a, least_b = least_rows(n1, n0, bar)
    paired = np.flatnonzero((a >= least_a) | (n - a >= least_b))
    if len(paired):
        first, same = _classes(np.array([(able[i]["m1"], able[i]["m2"]) for i in paired]))
        stands = spark.sparkContext.broadcast(ids[paired][first])
        _, toxic, _, sizes, flat = _arrays(rows.mapInArrow(lambda b: _blobs(b, stands), BLOBS).collect())  # the sample
        shared = spark.sparkContext.broadcast((flat, sizes, toxic == 1, score[paired][first], n1, n0, bar))
        del flat
        parts = 2 * spark.sparkContext.defaultParallelism
        best = spark.range(0, parts, 1, parts).mapInArrow(lambda b: _gains(b, shared, parts), "term long, gain double").groupBy("term").agg(F.max("gain").alias("gain")).collect()
        gain = np.zeros(len(first))
        for r in best:
            gain[r["term"]] = r["gain"]
        passed[paired] |= gain[same] >= bar
        shared.unpersist()
    chosen = spark.sparkContext.broadcast(ids[passed])
    return rows.mapInArrow(lambda b: _blobs(b, chosen), BLOBS).repartition(1).mapInArrow(lambda b: _fitted(b, chosen), MODEL)


class Scorer:
    def __init__(self, model: list) -> None:
        self.constant = next((r["weight"] for r in model if r["term"] < 0), -20.0)
        own = [r for r in model if r["term"] >= 0]
        self.number = {r["term"]: i for i, r in enumerate(own)}
        self.weights = np.array([r["weight"] for r in own])
        self.factors = np.array([r["factors"] for r in own]).reshape(len(own), FACTORS)
        self.known = Remembered(lambda w: tuple(self.number[t] for t in word_terms(w) if t in self.number), REMEMBERED)

    def terms(self, text: str | None) -> list[int]:
        return sorted(set().union(*filter(None, map(self.known.__getitem__, distinct_words(text)))))

    def score(self, text: str | None) -> float:
        z = self.constant
        if at := self.terms(text):
            v = self.factors[at]
            z += self.weights[at].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _score(batches, shared, text_at: int, names: list[str]):
    model = shared.value
    scorer = held(("toxicity", xxhash.xxh3_128_digest(repr(model))), lambda: Scorer(model))
    for batch in batches:
        scores = [scorer.score(t.as_py()) for t in batch.column(text_at)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names)


def score(docs: DataFrame, model: DataFrame, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1; a column of that name is replaced."""
    rows = model.collect()  # bounded by the sample
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    given = docs.drop(score_col)
    schema = T.StructType([*given.schema, T.StructField(score_col, T.DoubleType())])
    at, names = given.columns.index(text_col), [*given.columns, score_col]
    return spread(given).mapInArrow(lambda b: _score(b, shared, at, names), schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row's labels are kept from learning: every fifth by the id's CRC."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def reject_toxic(docs: DataFrame, model: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    return score(rows, model).filter(F.col("score") < threshold).select("row.*")
