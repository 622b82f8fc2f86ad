"""A source over a paginated service: page after page by cursor, as a batch or as a stream.

The stream's offset is each cursor's next page and the number of lines so far, so it
goes on where it was, and a batch that was under way is read again between its two
offsets.  Its pages pass through the driver one of each cursor at a time, as a cursor
is known only from the page before.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Callable, Iterator
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader


def fetch(url: str) -> tuple[bytes, str]:
    """Body and Link header of a page."""
    with urlopen(url, timeout=60) as answer:
        return answer.read(), answer.headers.get("Link", "")


def pages(url: str | None, get: Callable[[str], tuple[bytes, str]] = fetch) -> Iterator[str]:
    """The text of each page; gzip is told by its first bytes, the next page by ``rel="next"``."""
    while url:
        text, url = page(url, get)
        yield text


def page(url: str, get: Callable[[str], tuple[bytes, str]] = fetch) -> tuple[str, str | None]:
    """A page's text and the next page's url."""
    body, link = get(url)
    found = re.search(r'<([^>]+)>;\s*rel="next"', link)
    return (gzip.decompress(body) if body[:2] == b"\x1f\x8b" else body).decode(), found[1] if found else None


def lines(url: str, get: Callable[[str], tuple[bytes, str]] = fetch) -> Iterator[str]:
    """All lines; the header that each page repeats comes once."""
    header = None
    for text in pages(url, get):
        for n, line in enumerate(text.splitlines()):
            if n == 0 and header is not None:
                continue
            header = header if header is not None else line
            if line:
                yield line


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], get) -> None:
        self.urls, self.get = urls, get

    def partitions(self):
        return [InputPartition(u) for u in self.urls]

    def read(self, partition):
        yield from ((partition.value, n, line) for n, line in enumerate(lines(partition.value, self.get)))


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, urls: list[str], get) -> None:
        self.urls, self.get = urls, get

    def initialOffset(self) -> dict:
        return {u: {"next": u, "no": 0} for u in self.urls}

    def _step(self, url: str, at: dict) -> tuple[list[tuple], dict]:
        """The rows of a cursor's next page, and where it is then."""
        text, following = page(at["next"], self.get)
        own = [line for line in text.splitlines()[1 if at["no"] else 0 :] if line]
        return [(url, at["no"] + i, line) for i, line in enumerate(own)], {"next": following or "", "no": at["no"] + len(own)}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], dict(start)
        for url, at in start.items():
            if at["next"]:
                own, end[url] = self._step(url, at)
                rows += own
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for url, at in start.items():
            while at != end[url]:
                rows, at = self._step(url, at)
                yield from rows


def paged_source(get: Callable[[str], tuple[bytes, str]] = fetch) -> type[DataSource]:
    """A data source named ``paged`` whose ``urls`` (separated by spaces) are cursors to begin at, each one task."""

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return "paged"

        def schema(self):
            return "url string, no long, line string"

        def reader(self, schema):
            return _Reader(self.options["urls"].split(), get)

        def simpleStreamReader(self, schema):
            return _Stream(self.options["urls"].split(), get)

    return Paged


def read_paged(spark: SparkSession, urls: list[str], get: Callable[[str], tuple[bytes, str]] = fetch) -> DataFrame:
    spark.dataSource.register(paged_source(get))
    return spark.read.format("paged").option("urls", " ".join(urls)).load()


def stream_to(spark: SparkSession, urls: list[str], path: str, state: str, get: Callable[[str], tuple[bytes, str]] = fetch) -> None:
    """Appends the lines of all pages that are there to the Parquet table ``path``, each once, whatever runs under ``state`` have done before."""
    spark.dataSource.register(paged_source(get))
    rows = spark.readStream.format("paged").option("urls", " ".join(urls)).load()
    query = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
