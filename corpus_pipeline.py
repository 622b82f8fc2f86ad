"""The corpus pipeline: five stages, each written as Parquet and reread as the next one's documents.

Defined results, for every stage: null and empty texts stay (the last stage packs
them as the closing id alone), as do rows with a null id or nulls in other columns;
rows equal in id and text are kept or dropped alike, and each is packed; an id of
several texts is several documents; of ties the least id, then text hash, stays; a
long text is judged whole; other columns pass unchanged whatever their names, but
for ``n_chars``, which follows the text; empty tables give no rows, empty labels
reject nothing and an empty benchmark finds nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import decontamination, line_dedup, minhash, packing, toxicity
from helixframe.llm.queries import public_tokenizer
from helixframe.plans.staging import checkpoint_dir, staged, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model learned from the labels does not call toxic."""
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out())
    return toxicity.reject_toxic(docs, staged(toxicity.fit(docs, labels)))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one has; what nothing is left of goes."""
    left = line_dedup.dedup_lines(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, each with its sequence."""
    return packing.pack(docs, public_tokenizer())


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
