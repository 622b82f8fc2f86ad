"""NumPy archives (.npz) as a Spark data source: arrays by rows, read in parts and written with a commit.

Reading: an array that is stored plainly is cut into ranges of rows, each a task
that seeks to its own bytes; a compressed one, or one in column order, is one task.
Rows are (file, name, row, dtype, value, whole): ``value`` has a row's numbers as
doubles, ``whole`` has those of whole-numbered and boolean arrays; the other is null.
Further dimensions are laid out one after the other; an array of no dimension is one
row.  Arrays of objects are refused.

Writing: rows (name, row, value or whole) become archives in a folder, one for each
task, under names that only the commit of the job makes final; an array may span
several tasks, each with its first row beside it.  What a failed job left is removed.

Archives are opened with ``open``: the folder has to be mounted where tasks run.
"""

from __future__ import annotations

import os
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "file string, name string, row long, dtype string, value array<double>, whole array<long>"
#: Bytes of rows that a task reads from a plainly stored array, about; member that tells an array's first row.
PART_BYTES, FIRST = 64 << 20, "__first"


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


@dataclass
class _Member:
    shape: tuple[int, ...]
    dtype: np.dtype
    by_column: bool
    #: Bytes of the header within the member, and where the member's bytes begin in the file (none if compressed).
    header: int
    start: int | None


def _member(archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> _Member:
    with archive.open(info) as file:
        version = np.lib.format.read_magic(file)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, by_column, dtype = read(file)
        header = file.tell()
    if dtype.hasobject:
        raise ValueError(f"{info.filename} holds objects")
    start = None
    if info.compress_type == zipfile.ZIP_STORED:
        archive.fp.seek(info.header_offset + 26)  # lengths of the name and the extra field in front of the bytes
        name, extra = struct.unpack("<HH", archive.fp.read(4))
        start = info.header_offset + 30 + name + extra
    return _Member(shape, dtype, by_column, header, start)


class _Part(InputPartition):
    def __init__(self, path: str, name: str, first: int, low: int, high: int) -> None:
        self.path, self.name, self.first, self.low, self.high = path, name, first, low, high


def _archives(path: str) -> list[str]:
    path = _local(path)
    return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".npz") and f[0] not in "._") if os.path.isdir(path) else [path]


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.bytes = options["path"], int(options.get("partbytes", PART_BYTES))
        self.names = options.get("names", "").split() or None

    def partitions(self) -> list[InputPartition]:
        parts = []
        for path in _archives(self.path):
            with zipfile.ZipFile(path) as archive:
                infos = {i.filename.removesuffix(".npy"): i for i in archive.infolist() if i.filename.endswith(".npy")}
                for name, info in infos.items():
                    if name.endswith(FIRST) or self.names and name not in self.names:
                        continue
                    about = _member(archive, info)
                    first = int(np.load(archive.open(infos[name + FIRST]))) if name + FIRST in infos else 0
                    rows = about.shape[0] if about.shape else 1
                    size = max(int(np.prod(about.shape[1:], dtype=np.int64)) * about.dtype.itemsize, 1)
                    step = max(self.bytes // size, 1) if about.start is not None and not about.by_column else max(rows, 1)
                    parts += [_Part(path, name, first, at, min(at + step, rows)) for at in range(0, rows, step)]
        return parts or [_Part("", "", 0, 0, 0)]

    def read(self, part: _Part) -> Iterator[tuple]:
        if not part.path:
            return
        with zipfile.ZipFile(part.path) as archive:
            info = archive.getinfo(part.name + ".npy")
            about = _member(archive, info)
            if about.start is None or about.by_column:
                with archive.open(info) as file:
                    whole = np.lib.format.read_array(file, allow_pickle=False)
                x = np.atleast_1d(whole)[part.low : part.high]
            else:
                width = int(np.prod(about.shape[1:], dtype=np.int64))
                archive.fp.seek(about.start + about.header + part.low * width * about.dtype.itemsize)
                n = (part.high - part.low) * width
                x = np.frombuffer(archive.fp.read(n * about.dtype.itemsize), about.dtype)
        x = x.reshape(part.high - part.low, -1)
        whole = x.dtype.kind in "iub"
        for i, own in enumerate(x.astype(np.int64 if whole else float).tolist()):
            yield part.path, part.name, part.first + part.low + i, about.dtype.str, None if whole else own, own if whole else None


@dataclass
class _Written(WriterCommitMessage):
    path: str | None


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, names: list[str], overwrite: bool) -> None:
        self.folder, self.dtype, self.names, self.overwrite = _local(options["path"]), options.get("dtype"), names, overwrite
        os.makedirs(self.folder, exist_ok=True)

    def write(self, rows: Iterator) -> _Written:
        arrays: dict[str, tuple[int, list]] = {}
        for r in rows:
            r = dict(zip(self.names, r, strict=True))
            whole = r.get("whole")
            first, own = arrays.setdefault(r["name"], (r["row"], []))
            if r["row"] != first + len(own):
                raise ValueError(f"{r['name']}: row {r['row']} does not follow {first + len(own) - 1}")
            own.append(np.array(whole, np.int64) if whole is not None else np.array(r["value"], self.dtype or float))
        if not arrays:
            return _Written(None)
        members = {n: np.stack(own) for n, (_, own) in arrays.items()} | {n + FIRST: np.array(first) for n, (first, _) in arrays.items()}
        path = os.path.join(self.folder, f".{uuid.uuid4().hex}.npz")
        with open(path, "wb") as file:
            np.savez(file, **members)
        return _Written(path)

    def commit(self, messages: list) -> None:
        done = {m.path for m in messages if m and m.path}
        if self.overwrite:
            for old in _archives(self.folder):
                os.remove(old)
        for path in done:
            os.rename(path, os.path.join(self.folder, os.path.basename(path)[1:]))
        open(os.path.join(self.folder, "_SUCCESS"), "w").close()

    def abort(self, messages: list) -> None:
        for m in messages:
            if m and m.path and os.path.exists(m.path):
                os.remove(m.path)


class Npz(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), schema.names, overwrite)


def read_npz(spark: SparkSession, path: str, names: list[str] | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """The arrays of an archive, or of all archives in a folder, by rows."""
    spark.dataSource.register(Npz)
    reader = spark.read.format("npz").option("partbytes", str(part_bytes))
    return (reader.option("names", " ".join(names)) if names else reader).load(path)


def write_npz(rows: DataFrame, path: str, dtype: str | None = None, mode: str = "overwrite", tasks: int | None = None) -> None:
    """``rows`` (name, row, value or whole) as archives; rows of an array have to follow one another without gaps within a task.

    ``dtype`` is that of ``value`` (float64 unless named); ``tasks`` is how many archives to write at most.
    """
    rows.sparkSession.dataSource.register(Npz)
    dealt = rows.repartitionByRange(*([tasks] if tasks else []), "name", "row").sortWithinPartitions("name", "row")
    writer = dealt.write.format("npz").mode(mode)
    (writer.option("dtype", dtype) if dtype else writer).save(path)


def npz_once(rows: DataFrame, path: str) -> DataFrame:
    """The archives at ``path``, written from ``rows`` unless a job has committed them before."""
    if not os.path.exists(os.path.join(_local(path), "_SUCCESS")):
        write_npz(rows, path)
    return read_npz(rows.sparkSession, path)
