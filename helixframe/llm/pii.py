"""Personal data in texts: patterns with checks, and spans that a tagger adds.

The base spans are those of fixed patterns whose matches pass a check (Luhn, parts
of an address, number of digits).  They label the windows that a character-level
bidirectional LSTM with CRF transitions (``tagger``) is trained on, together with
the same windows in which the data are spelled in other ways ("name (at) host", a
phone number without its plus, a card number with dots) or replaced by numbers
that are none.  Texts are then read in overlapping windows; what the tagger finds in
each is put together over the whole text.

A span of the tagger holds an ``ANCHOR`` character, so windows without any are never
decoded, which changes nothing.  Parts of a span that windows cut are joined where
they overlap; of spans that exclude each other the set of most total probability
stays, over the whole text.  A span goes if it is less probable than ``SURE``, meets
a base span, or meets a match of its own kind's pattern that the check refused, and
its digits have to pass that check too.

The sample: texts of at most about ``MAX_DOCS`` documents, and of their windows with an
anchor at most ``MAX_WINDOWS`` that hold a base span and as many that don't, those
of the least hashes; equal windows count once.  One task trains on it.

Defined results: null and empty texts have no spans, null ids are carried, equal
rows each get their result, texts of any length are read whole in windows, places
count code points; other columns are ignored, ``redact`` passes them on whatever
their names; a sample without any base span gives an empty model, which adds
nothing; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm import tagger
from helixframe.llm.memory import held
from helixframe.plans.staging import spread, staged

KINDS = ["email", "ip", "card", "phone"]
#: Characters of a window, and from one window's start to the next.
WINDOW, STRIDE = 128, 64
#: Windows that are decoded at once.
AT_ONCE = 1024
#: Every span of the tagger holds one of these.
ANCHOR = re.compile(r"[0-9@(\[{]")
#: Least probability of each tag of a span that the tagger adds.
SURE = 0.8
MAX_DOCS, MAX_WINDOWS, HIDDEN, EPOCHS = 100_000, 2000, 20, 4
LEAST_EXAMPLES = 6000

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match begins where a run of digits does: from within the run the same match would fail.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
MODEL = "name string, shape array<int>, numbers array<float>"

Span = tuple[int, int, int]  # start, end, kind


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _card(text: str) -> bool:
    digits = "".join(_DIGITS.findall(text))
    return 12 <= len(digits) <= 19 and luhn(digits)


def _ip(text: str) -> bool:
    parts = [p.lstrip("0") for p in _DIGITS.findall(text)]
    return len(parts) == 4 and all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _phone(text: str) -> bool:
    return 9 <= sum(map(len, _DIGITS.findall(text))) <= 15


#: By kind, whether a span's text can be one.
CHECKS: list[Callable[[str], bool]] = [lambda text: True, _ip, _card, _phone]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern finds them, from each @ outwards, so that long runs are read once."""
    end, at = 0, text.find("@")
    while at >= 0:
        host, start = _DOMAIN.match(text, at + 1), at
        if host:
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
        if start < at:
            yield start, (end := host.end())
            at = end - 1
        at = text.find("@", at + 1)


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(spans, refused): what the patterns find, by whether it passes the check; in order of start and kind."""
    spans, refused = [], []
    for kind, found in enumerate((_emails(text), *((m.span() for m in p.finditer(text)) for p in (_IP, _CARD, _PHONE)))):
        for start, end in found:
            (spans if CHECKS[kind](text[start:end]) else refused).append((start, end, kind))
    return sorted(spans, key=lambda s: (s[0], s[2])), sorted(refused)


# Character classes: small and capital letters, punctuation, one for each kind of the rest; 0 is behind the end.
_CLASSES = 1 + 26 + 26 + 1 + 33 + 4
_TABLE = np.full(256, _CLASSES - 1, np.int64)
_TABLE[ord("a") : ord("z") + 1] = 1 + np.arange(26)
_TABLE[ord("A") : ord("Z") + 1] = 27 + np.arange(26)
_TABLE[ord("0") : ord("9") + 1] = 53
_TABLE[[c for c in range(32, 127) if not chr(c).isalnum()]] = 54 + np.arange(33)
_TABLE[[9, 10, 11, 12, 13]] = _CLASSES - 4
_TABLE[[c for c in range(128, 256) if chr(c).isalpha()]] = _CLASSES - 3


def classes(text: str) -> np.ndarray:
    """The classes of a window's characters, padded to its length."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    own = np.where(points < 256, _TABLE[np.minimum(points, 255)], _CLASSES - 2)
    return np.concatenate([own, np.zeros(WINDOW - len(own), np.int64)])


# Tag 0 is outside; 1 + 2 * kind begins a span and 2 + 2 * kind goes on with it.
_TAGS = 1 + 2 * len(KINDS)
_ALLOWED = np.ones((_TAGS, _TAGS), np.float32)
_ALLOWED[:, 2::2] = 0
for _kind in range(len(KINDS)):
    _ALLOWED[[1 + 2 * _kind, 2 + 2 * _kind], 2 + 2 * _kind] = 1
#: A window may begin inside a span.
_BEGINS = np.ones(_TAGS, np.float32)


def tags(spans: list[Span], begin: int = 0) -> np.ndarray:
    """The tags of a window from ``begin``; a span that is under way goes on, later ones give way to earlier."""
    out = np.zeros(WINDOW, np.int64)
    for start, end, kind in sorted(spans, reverse=True):
        low, high = max(start - begin, 0), min(end - begin, WINDOW)
        if low < high:
            out[low:high] = 2 + 2 * kind
            out[low] -= start >= begin
            if high < WINDOW and out[high] and out[high] % 2 == 0:  # the rest of a later span
                rest = out[high:]
                stop = int(np.argmax(rest != rest[0])) or len(rest)
                rest[:stop] = 0
    return out


def windows(text: str) -> Iterator[int]:
    """Starts of the windows that hold an anchor."""
    at, done = ANCHOR.search(text), -1
    while at:
        last = at.start() // STRIDE
        for k in range(max(last - WINDOW // STRIDE + 1, 0, done + 1), last + 1):
            if k == 0 or k * STRIDE + WINDOW - STRIDE < len(text):  # else the window before has all of it
                yield k * STRIDE
        done = last
        at = ANCHOR.search(text, (last + 1) * STRIDE)


def _sampled(batches, most: int):
    """The windows of the least hashes, with base spans and without, as (labelled, hash, text, spans)."""
    kept: list[dict[int, tuple]] = [{}, {}]
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not text or not ANCHOR.search(text):
                continue
            spans, _ = base_spans(text)
            starts = [s[0] for s in spans]
            for begin in windows(text):
                near = [s for s in spans[max(bisect_right(starts, begin) - 8, 0) : bisect_right(starts, begin + WINDOW)] if s[1] > begin and s[0] < begin + WINDOW]
                part = text[begin : begin + WINDOW]
                own = kept[bool(near)]
                own[xxhash.xxh3_64_intdigest(part.encode("utf-8", "surrogatepass")) >> 1] = part, [v for s in near for v in (s[0] - begin, s[1] - begin, s[2])]
                if len(own) > 4 * most:
                    for h in sorted(own)[most:]:
                        del own[h]
    rows = [(bool(i), h, *own[h]) for i, own in enumerate(kept) for h in sorted(own)[:most]]
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    kinds = (pa.bool_(), pa.int64(), pa.string(), pa.list_(pa.int32()))
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["labelled", "hash", "text", "spans"])


def _respelled(value: str, kind: int, rng: np.random.Generator) -> str:
    """Personal data as people write it to evade patterns, or by habit."""
    pick = lambda *ways: ways[rng.integers(len(ways))]
    if kind == 0:
        at, dot = pick((" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), ("[at]", "."), (" [at] ", "."), (" @ ", "."), ("{at}", "{dot}"))
        return value.replace("@", at).replace(".", dot)
    if kind == 1:
        return value.replace(".", pick("[.]", " . ", "(.)", ","))
    digits = "".join(_DIGITS.findall(value))
    if kind == 2:
        return pick(".", "  ", "/", "_").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    own, area, mid, end = digits[:-9], digits[-9:-7] + digits[-7], digits[-7:-4], digits[-4:]
    return pick(f"({area}) {mid}-{end}", f"{area}-{mid}-{end}", f"{area}.{mid}.{end}", f"00{own or 1} {area} {mid} {end}", f"{own or 1}-{area}-{mid}-{end}", f"0{area}/{mid}{end}")


def _unlike(rng: np.random.Generator) -> str:
    """Numbers and brackets that are no personal data."""
    n = lambda low, high: int(rng.integers(low, high))
    ways = (
        lambda: f"{n(1950, 2040)}-{n(1, 13):02}-{n(1, 29):02}", lambda: f"{n(1, 29)}.{n(1, 13)}.{n(1950, 2040)}", lambda: f"{n(0, 24):02}:{n(0, 60):02}:{n(0, 60):02}",
        lambda: f"{n(0, 20)}.{n(0, 30)}.{n(0, 99)}", lambda: f"{n(1, 999)},{n(0, 1000):03},{n(0, 1000):03}", lambda: str(n(1, 10 ** n(1, 17))), lambda: f"({n(1, 2040)})",
        lambda: f"{rng.bytes(n(4, 21)).hex()}", lambda: f"[{n(1, 99)}]", lambda: "(see above)", lambda: f"{n(1, 999)} (or {n(1, 999)})", lambda: f"${n(1, 999)}.{n(0, 100):02}",
        lambda: f"{n(10**15, 10**16 - 1)}", lambda: f"{n(10, 99)}-{n(100, 999)}-{n(1, 9)}", lambda: f"@{'abcdefgh'[: n(3, 9)]}", lambda: f"{n(1, 99)} @ {n(1, 99)}.{n(10, 99)}",
    )
    return ways[rng.integers(len(ways))]()


def examples(sample: list[tuple[str, list[Span]]], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(classes, tags) of the windows, and of those with spans also with their data respelled, or replaced by other numbers.

    A small sample is respelled several times over, up to ``LEAST_EXAMPLES``.
    """
    rng = np.random.default_rng(seed)
    ids, wanted = [], []
    times = min(max(LEAST_EXAMPLES // (4 * max(sum(bool(spans) for _, spans in sample), 1)), 1), 12)

    def add(text: str, spans: list[Span]) -> None:
        ids.append(classes(text[:WINDOW]))
        wanted.append(tags(spans))

    for text, spans in sample:
        add(text, spans)
        for way in range(4 * times - 1 if spans else 0):
            out, placed, done = "", [], 0
            for start, end, kind in spans:
                if start < done:
                    continue
                out += text[done:start]
                whole = start > 0 and end < len(text)
                unlike = way % 4 == 2 or whole and rng.random() < 0.1
                new = _unlike(rng) if unlike else _respelled(text[start:end], kind, rng) if whole else text[start:end]
                if not unlike:
                    placed.append((len(out), len(out) + len(new), kind))
                out, done = out + new, end
            add(out + text[done:], placed)
    return np.array(ids).reshape(-1, WINDOW), np.array(wanted).reshape(-1, WINDOW)


def _fitted(batches, epochs: int, hidden: int):
    rows = sorted((h, text, flat) for batch in batches for h, text, flat in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
    sample = [(text, [tuple(flat[i : i + 3]) for i in range(0, len(flat), 3)]) for _, text, flat in rows]
    params = {}
    if any(spans for _, spans in sample):
        params = tagger.trained(*examples(sample), tagger.created(_CLASSES, hidden, _TAGS), _ALLOWED, _BEGINS, epochs)
    columns = list(params), [list(v.shape) for v in params.values()], [v.ravel() for v in params.values()]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.list_(pa.int32())), pa.array(columns[2], pa.list_(pa.float32()))], ["name", "shape", "numbers"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS, max_windows: int = MAX_WINDOWS, epochs: int = EPOCHS, hidden: int = HIDDEN) -> DataFrame:
    """A model (name, shape, numbers: a row for each group of parameters) trained on the documents' base spans."""
    share = min(1.0, max_docs / max(docs.count(), 1))
    near = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(7)), F.lit(2**20)) < share * 2**20
    texts = docs.filter(near).select(F.col(text_col).cast("string").alias("text"))
    found = spread(texts).mapInArrow(lambda b: _sampled(b, max_windows), "labelled boolean, hash long, text string, spans array<int>")
    found = staged(found.dropDuplicates(["labelled", "hash"]))  # at most 2 * max_windows rows a task
    with_, without = (found.filter(c).orderBy("hash").limit(max_windows).select("hash", "text", "spans") for c in ("labelled", "not labelled"))
    return with_.unionAll(without).repartition(1).mapInArrow(lambda b: _fitted(b, epochs, hidden), MODEL)


def _edges(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without white space and closing marks at its ends."""
    while start < end and (text[start].isspace() or text[start] in ".,;:!?-"):
        start += 1
    while start < end and (text[end - 1].isspace() or text[end - 1] in ".,;:!?-"):
        end -= 1
    return start, end


def reconciled(text: str, found: list[tuple[int, int, int, float, bool]], base: list[Span], refused: list[Span]) -> list[Span]:
    """The spans that stand over the whole text, of what windows found: (start, end, kind, probability, whether a window's edge cuts it)."""
    joined: list[list] = []
    for kind in range(len(KINDS)):
        own = None
        for start, end, _, sure, cut in sorted(f for f in found if f[2] == kind):
            if own and start < own[1] and (cut or own[4]):  # parts of one
                own[1], own[3], own[4] = max(own[1], end), max(own[3], sure), own[4] and cut
            else:
                own = [start, end, kind, sure, cut]
                joined.append(own)
    best: dict[Span, float] = {}
    for start, end, kind, sure, _ in joined:
        start, end = _edges(text, start, end)
        value = text[start:end]
        if sure >= SURE and ANCHOR.search(value) and (kind != 0 or "." in value or "dot" in value.lower()) and CHECKS[kind](value):
            best[start, end, kind] = max(sure, best.get((start, end, kind), 0.0))
    barred = sorted([(s, e, None) for s, e, _ in base] + refused, key=lambda s: s[:2])
    reach = np.maximum.accumulate([e for _, e, _ in barred]) if barred else []
    begins = [s for s, _, _ in barred]

    def free(span: Span) -> bool:
        i = bisect_right(begins, span[1] - 1) - 1
        while i >= 0 and reach[i] > span[0]:
            s, e, kind = barred[i]
            if e > span[0] and kind in (None, span[2]):
                return False
            i -= 1
        return True

    # The set of spans apart from each other of most total probability.
    spans = sorted((s for s in best if free(s)), key=lambda s: (s[1], s[0], s[2]))
    ends = [s[1] for s in spans]
    total, take = [0.0], []
    for i, s in enumerate(spans):
        with_it = best[s] + total[bisect_right(ends, s[0], 0, i)]
        take.append(with_it > total[i])
        total.append(max(with_it, total[i]))
    out, i = [], len(spans) - 1
    while i >= 0:
        if take[i]:
            out.append(spans[i])
            i = bisect_right(ends, spans[i][0], 0, i) - 1
        else:
            i -= 1
    return out


class Finder:
    """Decodes windows of many texts together."""

    def __init__(self, model: list) -> None:
        self.params = {r["name"]: np.array(r["numbers"], np.float32).reshape(r["shape"]) for r in model}

    def _decode(self, waiting: list[tuple[int, int, str]], found: dict[int, list]) -> None:
        path, sure = tagger.decoded(self.params, np.array([classes(part) for _, _, part in waiting]), _ALLOWED, _BEGINS)
        for (row, begin, part), own, p in zip(waiting, path, sure, strict=True):
            own = own[: len(part)]
            if not own.any():
                continue
            # A span starts where its kind differs from the tag before, or where it begins anew.
            starts = np.flatnonzero((own > 0) & ((own % 2 == 1) | (np.concatenate([[0], own[:-1]]) == 0)))
            for s in starts.tolist() if own[0] == 0 or 0 in starts else [0, *starts.tolist()]:
                e = s + 1
                while e < len(own) and own[e] and own[e] % 2 == 0:
                    e += 1
                cut = s == 0 and begin > 0 or e == WINDOW
                found.setdefault(row, []).append((begin + s, begin + e, int(own[s] - 1) // 2, float(p[s:e].min()), cut))
        waiting.clear()

    def find(self, texts: list[str | None]) -> Iterator[tuple[list[Span], list[Span]]]:
        """(base, added) of each text."""
        found: dict[int, list] = {}
        waiting: list[tuple[int, int, str]] = []
        for row, text in enumerate(texts):
            if self.params and text:
                for begin in windows(text):
                    waiting.append((row, begin, text[begin : begin + WINDOW]))
                    if len(waiting) == AT_ONCE:
                        self._decode(waiting, found)
        if waiting:
            self._decode(waiting, found)
        for row, text in enumerate(texts):
            base, refused = base_spans(text) if text and ANCHOR.search(text) else ([], [])
            yield base, reconciled(text, found[row], base, refused) if row in found else []


def _spans(rows: list[list[Span]]) -> list[list[dict]]:
    return [[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in own] for own in rows]


def _find(batches, shared, text_at: int, names: list[str]):
    model = shared.value
    finder = held(("pii", xxhash.xxh3_128_digest(repr(model))), lambda: Finder(model))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        base, spans = [], []
        for own, added in finder.find(batch.column(text_at).to_pylist()):
            base.append(own)
            spans.append(sorted([*own, *added], key=lambda s: (s[0], s[2])))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_spans(base), kind), pa.array(_spans(spans), kind)], names)


def _found(rows: DataFrame, model: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with base and spans; none of its own columns may have these names."""
    known = [r.asDict() for r in model.orderBy("name").collect()]  # the tagger's parameters, of a fixed number
    shared = rows.sparkSession.sparkContext.broadcast(known)
    schema = T.StructType([*rows.schema, T.StructField("base", SPANS), T.StructField("spans", SPANS)])
    at, names = rows.columns.index(text_col), [*rows.columns, "base", "spans"]
    return spread(rows).mapInArrow(lambda b: _find(b, shared, at, names), schema)


def find(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end) in order of start and kind; ``spans`` has the base ones and what the tagger adds."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _found(given, model, "text").drop("text")


def redact(docs: DataFrame, model: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of its texts replaced by its kind in brackets; of overlapping ones the first, reaching to the end of them all."""
    rows = _found(docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).cast("string").alias("text")), model, "text")
    step = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda done, s: F.struct(
            F.when(s["start"] < done["at"], done["out"]).otherwise(F.concat(done["out"], F.substring("text", done["at"] + 1, s["start"] - done["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).alias("out"),
            F.greatest(done["at"], s["end"]).alias("at"),
        ),
    )
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.concat(step["out"], F.substring("text", step["at"] + 1, F.length("text"))))
    return rows.withColumn("row", F.col("row").withField(text_col, text)).select("row.*")


def count(kind: str, spans: str = "base") -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
