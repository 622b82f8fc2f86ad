"""Cutting lineage and shipping the package: what every iterative plan needs."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import broadcast


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate results.

    ``spark.checkpoint.dir`` decides.  Only a plain local session (tests, a
    notebook), where driver and executors are one process, may fall back on a
    temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if path := spark.conf.get("spark.checkpoint.dir", None):
            context.setCheckpointDir(path)
        elif context.master.startswith("local[") or context.master == "local":
            context.setCheckpointDir(tempfile.mkdtemp(prefix="helixframe-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return context.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Rows, and bytes of their values, up to which a table is broadcast; beyond, joins shuffle it.
SMALL, SMALL_BYTES = 300_000, 32_000_000


def _bytes(value: Column, kind: T.DataType) -> Column:
    """About the bytes of a value."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value) + 16
    elif isinstance(kind, T.StructType):
        size = sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(8))
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType)):
        size = F.aggregate(value, F.lit(24).cast("long"), lambda total, x: total + _bytes(x, kind.elementType))
    elif isinstance(kind, T.ArrayType):
        size = F.size(value) * 8 + 24
    elif isinstance(kind, T.MapType):
        return _bytes(F.map_entries(value), T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])))
    else:
        return F.lit(8).cast("long")
    return F.coalesce(size.cast("long"), F.lit(8))


def broadcast_if_small(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``df`` marked for broadcast if the staged table ``of`` (``df`` itself unless named), no shorter than it, is small by rows and bytes."""
    known = df if of is None else of
    size = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in known.schema.fields), F.lit(0))
    rows, total = known.limit(SMALL + 1).agg(F.count("*"), F.sum(size)).first()
    return broadcast(df) if rows <= SMALL and (total or 0) <= SMALL_BYTES else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    A scan of a large table already has more and is returned as it is, and so is
    what comes from a shuffle; only a table of a few file splits is dealt out
    before costly work on each row.
    """
    if df._jdf.queryExecution().executedPlan().toString().startswith("AdaptiveSparkPlan"):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def importable(spark: SparkSession) -> SparkSession:
    """``spark``, with this package's folder on its Python workers' path."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables in ``sf_dir``."""
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")
