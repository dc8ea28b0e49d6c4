"""Versions of files as a stream: the data source ``file_versions``.

``spark.readStream.format("file_versions").load(path)`` gives a row (path, modificationTime, length) for each file below a path whenever it
is new or has another time or length: files that are replaced in place come again, which Spark's own file source does not tell. Only listings
are read. Names that begin with a dot or an underscore are no data.

An offset is the latest modification time seen and a digest of what lies within ``slackSeconds`` before it. A batch lists what is later than
the offset before less the slack, so a file that a slow writer or a clock behind dates a little back is not lost, and a file within the slack may
come again: :func:`textloom.streaming.changed.newest_versions` keeps what was given from being given twice. A file that is dated back by
more than the slack is not seen. The driver lists, as for Spark's own file source; ``filesPerPart`` names go to each task.
"""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .archives import store_of

VERSIONS = "path string, modificationTime timestamp, length bigint"
_VERSIONS = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64())])
SLACK_SECONDS, FILES_PER_PART = 60, 10_000


def listed(path: str) -> Iterator[tuple[str, int, int]]:
    """Path, modification time in microseconds and length of each file below a path; none if there is no such path."""
    store, top = store_of(path)
    info = store.get_file_info(top)
    if info.type == fs.FileType.NotFound:
        return
    for i in [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(top, recursive=True)):
        inner = i.path[len(top) :].strip("/") if i.path != top else i.base_name
        if i.type == fs.FileType.File and not any(p.startswith((".", "_")) for p in inner.split("/")):
            yield named(path, i.path), modified(i), i.size


def named(path: str, found: str) -> str:
    """The path of a found file in the scheme of the path that was asked for."""
    scheme, sep, _ = path.partition("://")
    return f"{scheme}://{found}" if sep else f"file://{found}" if path.startswith("file:") else found


def modified(info: fs.FileInfo) -> int:
    return (info.mtime_ns or 0) // 1000


@dataclass
class Listed(InputPartition):
    files: list[tuple[str, int, int]]


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, slack_seconds: float, files_per_part: int):
        self.path, self.slack, self.step = path, int(slack_seconds * 1_000_000), files_per_part

    def initialOffset(self) -> dict:
        return {"time": -1, "digest": ""}

    def latestOffset(self) -> dict:
        files = list(listed(self.path))
        if not files:
            return self.initialOffset()
        last = max(t for _, t, _ in files)
        recent = sorted(f for f in files if f[1] > last - self.slack)
        return {"time": last, "digest": hashlib.sha256(repr(recent).encode()).hexdigest()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # a file that was changed since the end was fixed belongs to a later batch
        those = sorted(f for f in listed(self.path) if (start["time"] < 0 or f[1] > start["time"] - self.slack) and f[1] <= end["time"])
        return [Listed(those[i : i + self.step]) for i in range(0, len(those), self.step)]

    def read(self, partition: Listed) -> Iterator[pa.RecordBatch]:
        paths, times, lengths = zip(*partition.files, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(times, pa.int64()).cast(_VERSIONS.field(1).type), pa.array(lengths, pa.int64())], schema=_VERSIONS)


class FileVersions(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_versions"

    def schema(self) -> str:
        return VERSIONS

    def streamReader(self, schema) -> _Reader:
        if "path" not in self.options:
            raise ValueError("file_versions needs a path")
        return _Reader(self.options["path"], float(self.options.get("slackSeconds", SLACK_SECONDS)), int(self.options.get("filesPerPart", FILES_PER_PART)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileVersions)


def content_of(path: str, time: datetime.datetime) -> bytes | None:
    """The bytes of a version of a file; None if it is gone or has been replaced, before or while it was read."""
    store, name = store_of(path)
    want = int(time.timestamp()) * 1_000_000 + time.microsecond
    try:
        if modified(store.get_file_info(name)) != want:
            return None
        with store.open_input_stream(name) as f:
            data = f.read()
    except FileNotFoundError:
        return None
    return data if modified(store.get_file_info(name)) == want else None
