"""Readers and writers of the tabular and sequence formats, with stated schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators.prep import normalized_headers, required

PROTEINS = "accession string, sequence string, length int"
CLUSTERS = "cluster_id string, accession string"
ANNOTATIONS = "accession string, feature_type string, start int, end int, description string"


def read_tsv(spark: SparkSession, path: str, schema: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A table with a header; names are trimmed and lower-cased, empty fields are null, ragged lines are padded."""
    reader = spark.read.option("sep", "\t").option("header", True).option("mode", "PERMISSIVE").option("quote", "")
    df = normalized_headers((reader.schema(schema) if schema else reader).csv(path))
    return required(df, columns) if columns else df


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Representative and member, without a header."""
    return spark.read.option("sep", "\t").option("header", False).schema(CLUSTERS).csv(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """accession, sequence: a record for each line that starts with ``>``; ``sp|ACC|NAME`` gives ACC.

    A ``>`` within a line is text.  Of an accession's records the last stays, files in
    order of their paths; comment lines (``;``) in front of the first record are left out.
    """
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    record = F.regexp_replace("value", r"^(?:\s*\n)?>", "")  # the first record of a file has its own mark
    records = spark.read.option("lineSep", "\n>").text(path).select(place.alias("place"), F.split(record, "\r?\n", 2).alias("parts"))
    header = F.trim(F.get("parts", F.lit(0)))
    records = records.filter((header != "") & ~F.startswith(header, F.lit(";")))
    token = F.split(header, r"\s+")[0]
    accession = F.when(F.contains(token, F.lit("|")), F.split(token, r"\|")[1]).otherwise(token)
    sequence = F.regexp_replace(F.coalesce(F.get("parts", F.lit(1)), F.lit("")), r"\s+", "")
    rows = records.select("place", accession.alias("accession"), sequence.alias("sequence"))
    return rows.groupBy("accession").agg(F.max_by("sequence", "place").alias("sequence"))


def gff_rows(lines: DataFrame, value: str = "value") -> DataFrame:
    """ANNOTATIONS from GFF lines: no comments, nine fields at least, the last Note as description."""
    fields = F.split(F.trim(value), "\t")
    notes = F.filter(F.split(F.get("f", F.lit(8)), ";"), lambda a: F.startswith(a, F.lit("Note=")))
    description = F.coalesce(F.replace(F.try_element_at(notes, F.lit(-1)), F.lit("Note="), F.lit("")), F.lit(""))
    kept = lines.filter(~F.startswith(F.col(value), F.lit("#"))).withColumn("f", fields).filter(F.size("f") >= 9)
    return kept.select(
        F.get("f", F.lit(0)).alias("accession"), F.get("f", F.lit(2)).alias("feature_type"), F.get("f", F.lit(3)).cast("int").alias("start"), F.get("f", F.lit(4)).cast("int").alias("end"),
        description.alias("description"),
    )


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    return gff_rows(spark.read.text(path))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store Spark reads it from."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_first(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The first Parquet table that exists, else an empty one."""
    found = next((p for p in paths if exists(spark, p)), None)
    return spark.read.parquet(found) if found else spark.createDataFrame([], schema)


def read_parts(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """All part files of a folder that match; fails if there is none."""
    return spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).parquet(folder)


def read_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON objects; a bare NaN is read as such."""
    return spark.read.schema(schema).option("allowNonNumericNumbers", True).option("multiLine", True).json(path)


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite", single: bool = False) -> None:
    """``single`` puts a small result into one file."""
    (df.coalesce(1) if single else df).write.mode(mode).option("sep", "\t").option("header", True).csv(path)


def fasta_lines(sequences: DataFrame) -> DataFrame:
    """``value``: a record of two lines for each sequence that is not null or empty."""
    return sequences.filter(F.length("sequence") > 0).select(F.concat(F.lit(">"), F.col("accession").cast("string"), F.lit("\n"), "sequence").alias("value"))


def write_fasta(sequences: DataFrame, path: str) -> None:
    fasta_lines(sequences).write.mode("overwrite").text(path)


def write_metadata(spark: SparkSession, values: dict, path: str) -> None:
    """One JSON object."""
    spark.createDataFrame([values]).coalesce(1).write.mode("overwrite").json(path)


def write_once(df: DataFrame, path: str) -> DataFrame:
    """``df`` kept at ``path``, or what was kept there before."""
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_shards(df: DataFrame, path: str, by: str = "split", rows: int = 512) -> None:
    """Part files of at most ``rows`` rows in a folder for each ``by``; files appear with the commit of the job."""
    df.write.mode("overwrite").partitionBy(by).option("maxRecordsPerFile", rows).parquet(path)


def write_with_rejects(tagged: DataFrame, path: str, rejects: str, reason: str = "skip_reason") -> None:
    """Rows without a reason to one table, the others with theirs to another."""
    tagged.filter(F.col(reason).isNull()).drop(reason).write.mode("overwrite").parquet(path)
    tagged.filter(F.col(reason).isNotNull()).write.mode("overwrite").parquet(rejects)


def write_report(lines: DataFrame, path: str) -> None:
    """A text file of the ordered column ``line``."""
    lines.orderBy("no").select("line").coalesce(1).write.mode("overwrite").text(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
