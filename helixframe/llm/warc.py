"""WARC archives with revisit records, written and read by Spark.

Headers alone, a digest and an id, are shuffled by payload digest to find equal
payloads; of each group of at least ``least`` bytes the record of the largest id
is the response, and the others become revisit records that refer to its id, url
and date.
Archives are gzipped text files whose records carry fresh headers.  They are
read record by record, by Content-Length.

Defined results: a null html is an empty payload; a null url has no target
header, and white space or control characters in a url are percent-encoded; rows
of a null id are responses; equal rows of the largest id are all responses, and
revisits name the last of their urls; an
empty table gives archives without records; a long page is written and read whole.
Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from datetime import UTC, datetime
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.plans.staging import checkpoint_dir

#: Bytes from which on equal payloads are stored once.
LEAST = 1000
#: Records in one archive file; a file is read by one task.
RECORDS = 5000
#: Bytes of payloads that a reader hands on together.
BYTES_AT_ONCE = 32_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def _record_id(page: Column, digest: Column) -> Column:
    """A name-based UUID of a record."""
    h = F.sha1(F.concat_ws(" ", F.lit("warc-record"), page.cast("string"), digest).cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def with_revisits(pages: DataFrame, least: int = LEAST, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, n_bytes, digest, refers_to and refers_to_url (id and url of the response for revisits)."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    given = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = given.withColumns({"n_bytes": F.octet_length("payload").cast("long"), "digest": F.sha1(F.col("payload").cast("binary"))})
    headers = rows.filter((F.col("n_bytes") >= least) & F.col("page_id").isNotNull()).select("page_id", "url", "digest")
    first = headers.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("original"), F.min("page_id").alias("other")).filter("original.page_id != other")
    found = headers.select("page_id", "digest").join(first, "digest").filter("page_id != original.page_id")
    revisits = found.select(F.col("page_id").alias("rid"), F.col("digest").alias("rdigest"), F.col("original.page_id").alias("refers_to"), F.col("original.url").alias("refers_to_url")).distinct()
    return rows.join(revisits, (F.col("page_id") == F.col("rid")) & (F.col("digest") == F.col("rdigest")), "left").drop("rid", "rdigest")


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")


def _coded(url: Column) -> Column:
    """``url`` with white space and control characters percent-encoded."""
    coded = reduce(lambda text, c: F.replace(text, F.lit(chr(c)), F.lit(f"%{c:02X}")), [*range(33), 127], url)
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), coded).otherwise(url)


def records(rows: DataFrame, date: str | None = None) -> DataFrame:
    """``value``, the text of one WARC record, of now unless dated, for each row of ``with_revisits``, without the end mark."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", _coded(F.col("url"))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Profile", F.when(revisit, PROFILE)),
        _header("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to"), F.col("digest")))),
        _header("WARC-Refers-To-Target-URI", F.when(revisit, _coded(F.col("refers_to_url")))),
        _header("WARC-Refers-To-Date", F.when(revisit, F.lit(date))),
        _header("X-Page-ID", F.col("page_id").cast("string")),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length(block).cast("string")),
    )
    return rows.select(F.concat(head, F.lit("\r\n"), block).alias("value"))


def write(pages: DataFrame, path: str | None = None, **how) -> str:
    """Archives of ``pages`` in a new folder; the shared checkpoint folder is the default place."""
    path = path or f"{checkpoint_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    writer = records(with_revisits(pages, **how)).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS)
    writer.text(path)
    return path


def _parsed(content: bytes):
    """(headers, HTTP headers, payload) of each record of one archive."""
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as file:
        while line := file.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            head = {}
            while (line := file.readline().rstrip(b"\r\n")):
                name, _, value = line.decode().partition(": ")
                head[name] = value
            block = file.read(int(head["Content-Length"]))
            http, _, payload = block.partition(b"\r\n\r\n")
            yield head, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


FIELDS = "page string, url string, record_type string, record_id string, refers_to_id string, digest string, payload_bytes long, payload binary"


def _read(batches, with_payload: bool):
    kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]
    names = [f.split()[0] for f in FIELDS.split(", ")]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for head, http, payload in _parsed(content.as_py()):
                kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"payload and digest differ in record {head['WARC-Record-ID']}")
                kept = payload if with_payload and kind == "response" else None
                rows.append((head.get("X-Page-ID"), head.get("WARC-Target-URI"), kind, head["WARC-Record-ID"], head.get("WARC-Refers-To"), digest, int(http["Content-Length"]), kept))
                size += len(kept or b"")
                if size >= BYTES_AT_ONCE:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of all archives in ``path``, as FIELDS says."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(lambda b: _read(b, with_payload), FIELDS)


def resolved(found: DataFrame) -> DataFrame:
    """Each record with refers_to, the page of the response that a revisit refers to, and its payload where read.

    ``found`` is used twice: stage it, unless payloads are read, to parse the archives once.
    """
    originals = found.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page").alias("refers_to"), F.col("payload").alias("its_payload")).dropDuplicates(["refers_to_id"])
    joined = found.join(originals, "refers_to_id", "left")
    return joined.withColumn("payload", F.coalesce("payload", "its_payload")).drop("its_payload", "refers_to_id")
