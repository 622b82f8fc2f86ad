"""Whitening of embeddings by the covariance of their distinct quantised vectors.

Components become whole numbers, so sums are exact and a row is centred without
rounding: ``n * x - S``, with the number n of distinct vectors and their sums S.
Spark MLlib's RowMatrix over these rows gives the Gram matrix; divided by n it is
the covariance, whose unit eigenvectors are taken on the driver (a matrix of the
vectors' length) and sent to the tasks that project the rows.  The covariance of
the projected vectors is measured by a second Gram matrix.

Defined results: a row whose vector is null or holds null, NaN or infinite
components is left out, as is one of no components; a null id is carried; equal
rows each get their result, and equal vectors count once in the fit, however many
rows have them; vectors of different lengths are fitted apart; a component without
variance (at most ``FLAT`` of the largest, as if there are fewer vectors than
components) has a null ``whitened`` and explains nothing, and the error is over the
others, 0 if there are none; of eigenvectors v and -v the one whose largest entry
is positive is taken; components beyond 64 bits after scaling become the largest or
least long, and a deviation of over 38 digits is null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.plans.staging import spread, staged

#: Share of the largest eigenvalue up to which one is taken for zero.
FLAT = 1e-12
#: Whole numbers of this size and more are not counted in 64 bits.
_WIDE = 1 << 62


@dataclass
class Whitening:
    """What a table's vectors of one length are whitened by."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    eigenvalues: np.ndarray
    #: A column for each component.
    vectors: np.ndarray
    #: Share of the whole variance, by component.
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def scales(self) -> np.ndarray:
        """1 / sqrt(eigenvalue), NaN for a component without variance."""
        flat = self.eigenvalues <= FLAT * max(self.eigenvalues.max(), 0.0)
        return np.where(flat, np.nan, 1 / np.sqrt(np.where(flat, 1.0, self.eigenvalues)))


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, x): ``floor(scale * component)`` of each usable vector."""
    given = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return given.filter(F.col("v").isNotNull() & (F.size("v") > 0) & finite).select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(scale)))).alias("x"))


def _rows(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy())


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: in 64 bits if it fits, else as Python's whole numbers."""
    most = n * max(int(x.max()), -int(x.min())) + max(map(abs, sums))
    if most < _WIDE:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _deviations(centred: np.ndarray) -> list[int]:
    """Each row's sum of squares, exactly."""
    most = max(int(centred.max()), -int(centred.min()))
    wide = centred if most * most * centred.shape[1] < _WIDE else centred.astype(object)
    return (wide * wide).sum(1).tolist()


def _sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        if len(frame):
            x = _rows(frame["x"])
            wide = x if max(int(x.max()), -int(x.min())) * len(x) < _WIDE else x.astype(object)
            yield pd.DataFrame({"at": np.arange(x.shape[1]), "total": [Decimal(int(v)) for v in wide.sum(0)], "rows": len(x)})


def _gram(rows: DataFrame, n: int, dim: int) -> np.ndarray:
    """The Gram matrix of the column ``row`` (array<double>)."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("row").alias("row")), "row")
    return RowMatrix(vectors, n, dim).computeGramianMatrix().toArray()


def _projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    return (_centred(x, model.n, model.sums).astype(float) / model.n) @ model.vectors * model.scales


def fit(x: DataFrame, dim: int, components: int | None = None) -> Whitening:
    """The whitening of the distinct vectors ``x`` of length ``dim``, for the first ``components`` (all unless named)."""
    distinct = staged(x.filter(F.size("x") == dim).select("x").distinct())
    totals = distinct.mapInPandas(_sums, "at int, total decimal(38,0), rows long").groupBy("at").agg(F.sum("total").alias("total"), F.sum("rows").alias("rows")).orderBy("at").collect()  # a row for each dimension
    n, sums = totals[0]["rows"], [int(r["total"]) for r in totals]

    def centred(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"row": list(_centred(_rows(frame["x"]), n, sums).astype(float) / n)})

    covariance = _gram(distinct.mapInPandas(centred, "row array<double>"), n, dim) / n
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[: components or dim]
    values, vectors = values[order], vectors[:, order]
    largest = np.take_along_axis(vectors, np.abs(vectors).argmax(0)[None], 0)
    trace = float(np.trace(covariance))
    model = Whitening(n, sums, covariance, values, vectors * np.where(largest < 0, -1.0, 1.0), np.zeros(len(values)))
    scales = model.scales
    used = np.isfinite(scales)
    model.explained = np.where(used, values / trace, 0.0) if trace > 0 else model.explained
    if used.any():

        def whitened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    yield pd.DataFrame({"row": list(_projected(_rows(frame["x"]), model)[:, used])})

        # The whitened rows are centred as they are: n * x - S adds up to zero exactly.
        found = _gram(distinct.mapInPandas(whitened, "row array<double>"), n, int(used.sum())) / n
        model.identity_error = float(np.abs(found - np.eye(len(found))).max())
    return model


def whiten(x: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation decimal(38,0), whitened array<double>) of the rows of the model's length."""
    shared = x.sparkSession.sparkContext.broadcast(model)  # a matrix of the vectors' length
    schema = T.StructType([x.schema["vec_id"], T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for frame in frames:
            if len(frame):
                rows = _rows(frame["x"])
                deviations = _deviations(_centred(rows, known.n, known.sums))
                yield pd.DataFrame({"vec_id": frame["vec_id"], "deviation": [Decimal(v) if v < 10**38 else None for v in deviations], "whitened": list(_projected(rows, known))})

    return spread(x.filter(F.size("x") == len(model.sums))).mapInPandas(run, schema)


def whitened(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """A row for each usable vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    ``deviation`` is the vector's squared distance from the mean, times n squared.
    """
    spark, x = vectors.sparkSession, quantised(vectors, id_col, vec_col, scale)
    own = x.schema["vec_id"]
    schema = T.StructType([
        own, T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.DecimalType(38, 0)),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ])
    out = None
    for row in x.select(F.size("x").alias("dim")).distinct().orderBy("dim").collect():  # a row for each length of vectors
        model = fit(x, row["dim"], components)
        shares = F.array(*[F.lit(float(e)) for e in model.explained])
        long = whiten(x, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "value"))
        part = long.select(
            "vec_id",
            (F.col("at") + 1).cast("int").alias("component"),
            F.lit(model.n).cast("long").alias("n"),
            "deviation",
            F.nanvl("value", F.lit(None).cast("double")).alias("whitened"),
            F.element_at(shares, F.col("at") + 1).alias("explained"),
            F.lit(model.identity_error).alias("identity_error"),
        )
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out
