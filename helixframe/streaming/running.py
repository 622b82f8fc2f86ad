"""Running statistics over an append-only stream, with Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.plans.bindings import rounded
from helixframe.plans.staging import checkpoint_dir


def statistics(events: DataFrame, key: str = "event_type", value: str = "value") -> DataFrame:
    """Per key count, mean, variance, largest value and share of values above 0; all of them merge, so a stream keeps a row for each key."""
    mean = F.avg(value)
    return events.groupBy(key).agg(
        F.count("*").alias("n"), mean.alias("mean"), F.greatest(F.avg(F.col(value) * F.col(value)) - mean * mean, F.lit(0.0)).alias("variance"), F.max(value).alias("max"),
        F.avg((F.col(value) > 0).cast("double")).alias("nonzero"),
    )


def windowed(events: DataFrame, width: str = "1 day", late: str = "1 hour", time: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """The same over tumbling windows of event time; rows later than ``late`` are left out."""
    rows = events.withWatermark(time, late).groupBy(F.window(time, width), key)
    return rows.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max")).select(F.col("window.start").alias("start"), key, "n", "mean", "max")


def available_now(spark: SparkSession, source: str, target: str, schema: str) -> None:
    """All files of ``source`` so far, once each over repeated calls: the statistics of everything seen end up in ``target``."""
    stream = spark.readStream.schema(schema).parquet(source)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    query = statistics(stream).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{target}-state").trigger(availableNow=True).start()
    query.awaitTermination()


def replayed(events: DataFrame, parts: int = 4) -> DataFrame:
    """The statistics of a table that is written in parts and read as a stream."""
    spark = events.sparkSession
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = events.select("event_id", "event_type", "value")
    rows.repartition(parts, "event_id").write.parquet(f"{folder}/source")
    available_now(spark, f"{folder}/source", f"{folder}/target", "event_id long, event_type string, value double")
    return rounded(spark.read.parquet(f"{folder}/target"))


def replayed_windows(events: DataFrame, parts: int = 4, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """The windows that a stream has closed, of a table that arrives in order of time in so many files."""
    spark = events.sparkSession
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    low, high = rows.select(F.min("ts").cast("double"), F.max("ts").cast("double")).first()
    at = F.least(F.floor((F.col("ts").cast("double") - F.lit(low)) / F.lit(max(high - low, 1e-6)) * parts), F.lit(parts - 1)) if low is not None else F.lit(0)
    for part in range(parts):  # files of a later write are read later
        rows.filter(at == part).coalesce(1).write.mode("append").parquet(f"{folder}/source")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/source")
    closed = windowed(stream, width, late).writeStream.outputMode("append").format("parquet").option("path", f"{folder}/target").option("checkpointLocation", f"{folder}/state")
    closed.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(windowed(rows, width, late).schema).parquet(f"{folder}/target")
