"""Embeddings, attention or logits from a model that the user brings.

A provider is a function from sequences to one array for each; it runs on
batches inside tasks, and a sequence that it fails on becomes a row with the
error instead of ending the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Provider = Callable[[list[str]], list[np.ndarray]]

#: Numbers handed to Spark at a time: the arrays of a long sequence by layers and heads are never all in one batch.
VALUES = 2**18

#: A stretch of an answer: its key, a column for each whole number, a row of numbers for each position, or the error.
Part = tuple[object, list[np.ndarray], np.ndarray | None, str | None]


def _vectors(x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    return [np.arange(1, len(x) + 1)], x


def _weights(x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    return [at.ravel() + 1 for at in np.indices(x.shape[:3], np.int32)], x.reshape(-1, x.shape[3])


def _batch(parts: list[Part], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    """The parts as rows; an error is a row whose other columns are null."""
    counts = [1 if x is None else len(x) for _, _, x, _ in parts]
    widths = np.repeat([0 if x is None else x.shape[1] for _, _, x, _ in parts], counts)
    failed = np.repeat([x is None for _, _, x, _ in parts], counts)
    columns = [pa.array([k for k, *_ in parts], kind).take(pa.array(np.repeat(np.arange(len(parts)), counts)))]
    for i in range(len(names) - 3):
        columns.append(pa.array(np.concatenate([np.zeros(1) if x is None else whole[i] for _, whole, x, _ in parts]).astype(np.int32), mask=failed))
    values = np.concatenate([np.zeros(0), *[x.astype(float).ravel() for _, _, x, _ in parts if x is not None]])
    offsets = pa.array(np.concatenate([[0], np.cumsum(widths)]).astype(np.int32), mask=np.append(failed, False))
    columns.append(pa.ListArray.from_arrays(offsets, pa.array(values)))
    columns.append(pa.array([e for _, _, _, e in parts], pa.string()).take(pa.array(np.repeat(np.arange(len(parts)), counts))))
    return pa.RecordBatch.from_arrays(columns, names)


def _mapped(sequences: DataFrame, make: Callable[[], Provider], longest: int, batch: int, fits: Callable[[np.ndarray, int], bool], expand: Callable, schema: str) -> DataFrame:
    def parts(provider: Provider, keys: list, texts: list[str]) -> Iterator[Part]:
        try:
            found = [np.asarray(x) for x in provider(texts)]
            wrong = next((k for k, t, x in zip(keys, texts, found, strict=True) if not fits(x, len(t))), None)
            if wrong is not None:
                raise ValueError(f"{wrong}: as many rows as residues are expected")
        except Exception as error:  # noqa: BLE001  a provider may fail in any way
            if len(texts) > 1:
                for k, t in zip(keys, texts, strict=True):
                    yield from parts(provider, [k], [t])
            else:
                yield keys[0], [], None, f"{type(error).__name__}: {error}"[:500]
            return
        for k, found_x in zip(keys, found, strict=True):
            whole, x = expand(found_x)
            step = max(1, VALUES // max(1, x.shape[1]))
            for at in range(0, len(x), step):
                yield k, [c[at : at + step] for c in whole], x[at : at + step], None

    names = ["accession", *[c.split()[0] for c in schema.split(",")], "error"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        waiting: list[Part] = []
        size = 0
        for frame in frames:
            kind, keys, texts = frame.schema.field("accession").type, frame["accession"].to_pylist(), frame["sequence"].to_pylist()
            for at in range(0, len(keys), batch):
                for part in parts(provider, keys[at : at + batch], [t[:longest] for t in texts[at : at + batch]]):
                    waiting.append(part)
                    size += 1 if part[2] is None else part[2].size + len(part[2])
                    if size >= VALUES:
                        yield _batch(waiting, kind, names)
                        waiting, size = [], 0
        if waiting:
            yield _batch(waiting, kind, names)

    kind = sequences.schema["accession"].dataType.simpleString()
    used = sequences.select("accession", "sequence").filter("length(sequence) > 0")
    return used.mapInArrow(run, f"accession {kind}, {schema}, error string")


def provided(sequences: DataFrame, make: Callable[[], Provider], longest: int = 1022, batch: int = 16) -> DataFrame:
    """accession, pos, x, error: a row for each position, or one with the error and no position.

    The provider gives an array of a row for each position.  ``make`` is called
    once in each task, to load the model there.  Batches are of similar length if
    the rows come sorted by it.
    """
    return _mapped(sequences, make, longest, batch, lambda x, n: x.ndim == 2 and len(x) == n, _vectors, "pos int, x array<double>")


def attended(sequences: DataFrame, make: Callable[[], Provider], longest: int = 1022, batch: int = 1) -> DataFrame:
    """accession, layer, head, query, weights, error: a query's weights over all keys in a row, all counted from 1, or the error.

    The provider gives an array of layers x heads x positions x positions.
    """
    return _mapped(sequences, make, longest, batch, lambda x, n: x.ndim == 4 and x.shape[2:] == (n, n), _weights, "layer int, head int, query int, weights array<double>")


def by_key(attention: DataFrame) -> DataFrame:
    """accession, layer, head, query, key, weight of ``attended`` rows without an error."""
    rows = attention.filter("error IS NULL").select("accession", "layer", "head", "query", F.posexplode("weights").alias("key", "weight"))
    return rows.withColumn("key", F.col("key") + 1)
