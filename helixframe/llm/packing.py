"""Best-fit packing of documents into sequences of a fixed number of tokens.

The plan is made over the histogram of piece lengths, never over documents:
best fit, longest first, moves whole runs of equal pieces at once.  Documents
then take the planned slots by a join on (length, rank within the length).

Defined results: a null or empty text is a document of the closing id alone;
equal rows are separate documents; a null id is carried through; an empty table
gives no rows; a text of any length is encoded whole, by its chunks, and cut into
pieces; of pieces of equal length any may take either slot, those of equal id, number
and CRC in any order.  Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.memory import held
from helixframe.plans.staging import spread, staged

#: Bytes of chunks and their ids that a worker remembers; beyond, the most used half stays.
REMEMBERED = 80_000_000
#: Bytes of a chunk besides its own and its ids'.
ENTRY = 170
#: Words that are encoded as one text.
AT_ONCE = 1000
#: Bytes of text whose chunks are looked up together.
BYTES_AT_ONCE = 1_000_000
#: Marks that the tokenizer splits from a word before them.
MARKS = b".,;:!?%*#&$|"
#: Groups that ranks are counted in, over all lengths together.
RANK_GROUPS = 4096


class _Numbers(dict):
    """Numbers of chunks, given as they are met; ``new`` has those since it was last emptied."""

    def __init__(self, known=()) -> None:
        super().__init__(known)
        self.new: list[bytes] = []

    def __missing__(self, chunk: bytes) -> int:
        number = self[chunk] = len(self)
        self.new.append(chunk)
        return number


class _Coder:
    """The ids of texts under one tokenizer that drops white space and lower-cases.

    What stands on both sides of white space is never joined, so a text's ids
    are those of its chunks, and a chunk is encoded only once: chunks are
    numbered, and a number's ids stand at a place of one long array.  Marks behind
    a letter or a digit are tokens of their own; words of letters alone are encoded
    many at a time and told apart by their last token, the only one with a word end.
    """

    def __init__(self, text: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.numbers, self.bytes = _Numbers(), 0
        self.start = self.length = self.used = np.zeros(0, np.int64)
        self.ids, self.filled = np.zeros(1 << 16, np.uint32), 0

    def _add(self, ids: np.ndarray) -> int:
        """Puts ``ids`` behind the others, and returns where."""
        begin, self.filled = self.filled, self.filled + len(ids)
        if self.filled > len(self.ids):
            self.ids = np.concatenate([self.ids[:begin], np.zeros(max(self.filled, len(self.ids)), np.uint32)])
        self.ids[begin : self.filled] = ids
        return begin

    def _set(self, numbers, ids: np.ndarray, length: np.ndarray) -> None:
        """``ids`` has those of each of ``numbers`` in turn."""
        self.start[numbers] = self._add(ids) + np.cumsum(length) - length
        self.length[numbers] = length

    def _gathered(self, numbers: np.ndarray) -> np.ndarray:
        length = self.length[numbers]
        before = np.cumsum(length) - length
        return self.ids[np.repeat(self.start[numbers] - before, length) + np.arange(length.sum())]

    def _encode(self, numbers: list[int], chunks: list[bytes]) -> None:
        for at in range(0, len(chunks), AT_ONCE):
            coded = [x.ids for x in self.tokenizer.encode_batch_fast([c.decode() for c in chunks[at : at + AT_ONCE]], add_special_tokens=False)]
            self._set(numbers[at : at + AT_ONCE], np.fromiter(chain.from_iterable(coded), np.uint32), np.array([len(x) for x in coded], np.int64))

    def _encode_words(self, numbers: list[int], words: list[bytes]) -> None:
        for at in range(0, len(words), AT_ONCE):
            part, own = words[at : at + AT_ONCE], numbers[at : at + AT_ONCE]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                self._set(own, ids, np.diff(ends, prepend=0))
            else:  # a letter that lower-cases to more than letters
                self._encode(own, part)

    def _learn(self) -> None:
        numbers, new = self.numbers, self.numbers.new
        words, others, parts = [], [], []
        for number, chunk in enumerate(new, len(self.length)):  # which grows by words and marks that are new themselves
            word = chunk.rstrip(MARKS)
            if not word.isalpha():
                last = word.decode().lower()[-1:]  # a letter may end in a mark when lower-cased
                if not (last.isalnum() and (last.isalpha() or last.isascii())):
                    others.append(number)
                    continue
            if len(word) < len(chunk):
                parts.append((number, numbers[word], numbers[chunk[len(word) :]]))
            else:
                (words if word.isalpha() or word.decode().isalpha() else others).append(number)
        base = len(self.length)
        grown = np.zeros(len(new), np.int64)
        self.start, self.length, self.used = (np.concatenate([x, grown]) for x in (self.start, self.length, self.used))
        self._encode(others, [new[n - base] for n in others])
        self._encode_words(words, [new[n - base] for n in words])
        if parts:
            whole = np.array(parts)
            both = whole[:, 1:]
            self._set(whole[:, 0], self._gathered(both.ravel()), self.length[both].sum(1))
        self.bytes += sum(map(len, new)) + ENTRY * len(new)
        new.clear()

    def _shrink(self) -> None:
        """Forgets the less used half of the chunks."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: len(self.used) // 2])
        ids, kept = self._gathered(keep), set(keep.tolist())
        names = [c for c, n in self.numbers.items() if n in kept]
        self.numbers = _Numbers(zip(names, range(len(names)), strict=True))
        self.used, length = self.used[keep] // 2, self.length[keep]
        self.start, self.length = np.zeros(len(keep), np.int64), np.zeros(len(keep), np.int64)
        self.ids, self.filled = np.zeros(max(len(ids), 1 << 16), np.uint32), 0
        self._set(np.arange(len(keep)), ids, length)
        self.bytes = sum(map(len, names)) + ENTRY * len(names)

    def encoded(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        if self.bytes + 4 * self.filled > REMEMBERED:
            self._shrink()
        if self.special(texts):
            chunked = [[c if b"<|" in c else c.lower() for c in (t or "").encode().split()] for t in texts]
        else:
            chunked = [(t or "").encode().lower().split() for t in texts]
        number = self.numbers.__getitem__
        own = np.fromiter(map(number, chain.from_iterable(chunked)), np.int64)
        self._learn()
        self.used += np.bincount(own, minlength=len(self.used))
        end = 0
        for chunks in chunked:
            begin, end = end, end + len(chunks)
            yield self._gathered(own[begin:end])

    @staticmethod
    def special(texts: list[str | None]) -> bool:
        """Whether a text may hold a special token, whose case counts."""
        return any(t and "<|" in t for t in texts)


def _slices(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts in runs of about BYTES_AT_ONCE, at least one in each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // BYTES_AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for begin, end in pairwise(cuts):
        if end > begin:
            yield texts.slice(begin, end - begin).to_pylist()


def _pieces(batches, tokenizer_json, size: int, end_id: int, with_ids: bool):
    coder = held(("packing", hash(tokenizer_json.value)), lambda: _Coder(tokenizer_json.value))
    end = np.array([end_id], np.uint32)
    for batch in batches:
        row, piece, start, length, crc, ids = [], [], [], [], [], []
        for i, coded in enumerate(chain.from_iterable(map(coder.encoded, _slices(batch.column(1))))):
            whole = np.concatenate([coded, end]).astype("<u4", copy=False)
            for n, begin in enumerate(range(0, len(whole), size)):
                part = whole[begin : begin + size]
                row.append(i)
                piece.append(n)
                start.append(begin)
                length.append(len(part))
                crc.append(zlib.crc32(part))
                if with_ids:
                    ids.append(part.astype(np.int32))
        out = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            out.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(out, names)


def token_pieces(
    docs: DataFrame, tokenizer_json: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Each document's ids and the closing id, cut into pieces of at most ``size``."""
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = [
        given.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    shared = spark.sparkContext.broadcast(tokenizer_json)  # one vocabulary, of a fixed size
    return spread(given).mapInArrow(lambda b: _pieces(b, shared, size, end_id, with_ids), T.StructType(fields))


def best_fit(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Slots for ``counts`` pieces of each length: best fit, longest first.

    Returns rows (length, first rank, sequences, first sequence, offset): from
    its first rank on, a row's pieces go one to each of its sequences, then to
    the same sequences again behind the first, as often as the row's share of
    ranks has room for.  A step uses up either a group of equal sequences or a
    length, so the rows depend on the number of lengths, not of documents.
    """
    rows, open_, free, made = [], {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_:
                open_[room] = []
                insort(free, room)
            open_[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(free, length)
            if at < len(free):
                room = free[at]
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    free.pop(at)
            else:
                room, first, n = size, made, -(-left // (size // length))
                made += n
            copies = room // length
            full = min(n, left // copies)
            if full:
                rows.append((length, rank, full, first, size - room))
                rank, left = rank + full * copies, left - full * copies
                put(room - copies * length, first, full)
            rest = n - full
            if rest and left:  # fewer than one sequence's worth
                rows.append((length, rank, 1, first + full, size - room))
                put(room - left * length, first + full, 1)
                full, rest, rank, left = full + 1, rest - 1, rank + left, 0
            put(room, first + full, rest)
    return rows


def pack(docs: DataFrame, tokenizer_json: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence and the offset that each takes.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, and
    ids with ``with_ids``.
    """
    spark = docs.sparkSession
    pieces = staged(token_pieces(docs, tokenizer_json, size, end_id, id_col, text_col, with_ids))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    total = sum(counts.values())
    slots = best_fit(counts, size)
    # A common length is ranked in several groups, by a count of each and a running sum.
    groups = [(length, -(-n * RANK_GROUPS // total)) for length, n in counts.items()]
    shares = spark.createDataFrame(groups, "length long, groups long")
    keyed = pieces.join(F.broadcast(shares), "length").withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("groups")))
    sizes = keyed.groupBy("length", "share").agg(F.count("*").alias("n"))  # at most lengths + RANK_GROUPS rows
    before = sizes.select("length", "share", (F.sum("n").over(Window.partitionBy("length").orderBy("share")) - F.col("n")).alias("before"))
    within = Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        keyed.withColumn("nth", F.row_number().over(within) - 1)
        .join(F.broadcast(before), ["length", "share"])
        .withColumn("rank", F.col("before") + F.col("nth"))
    )
    plan = spark.createDataFrame(
        [(length, rank, n, first, offset) for length, rank, n, first, offset in slots], "slot_length long, first_rank long, n long, first_sequence long, first_offset long"
    )
    following = F.lead("first_rank", 1, 2**62).over(Window.partitionBy("slot_length").orderBy("first_rank"))
    plan = plan.withColumn("next_rank", following)
    nth = F.col("rank") - F.col("first_rank")
    placed = ranked.join(
        F.broadcast(plan), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("next_rank"))
    ).withColumns({
        "sequence_id": F.col("first_sequence") + nth % F.col("n"),
        "offset": F.col("first_offset") + F.expr("(rank - first_rank) div n") * F.col("length"),
    })
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, from ``pack(..., with_ids=True)``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most `size` ids together
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
