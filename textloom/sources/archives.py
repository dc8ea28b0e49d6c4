"""Archives that many tasks read and write: the data source ``archive``.

``spark.read.format("archive").load(path)`` gives a row for each file in each zip or tar below a path. An archive is cut into parts of
about ``partBytes``, ranges of a zip's directory or of a tar's chain of headers, and a task reads its part alone by
seeking, so an archive of any size is read by as many tasks as it has parts. The planner reads directories of zips as streams and keeps ranges
only. A tar has no directory; :func:`members` lets tasks guess in parallel where each range's first header lies, and the planner
checks that the guesses join up (without it the planner follows all headers itself, with equal parts).

``df.write.format("archive").save(path)`` writes rows of (entry, content) as zips or tars, one or more a task, that appear when all
tasks are done. Files are opened by ``pyarrow.fs``, in any store that it knows by URI.

Rows: archive, position (rising in the archive's order), entry, size, content, error. A member that cannot be read is a row with
error and no content; damage of an archive is a row with error and no entry, after what could be read. An error of the store is no damage:
it fails the task, which Spark runs again.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import tarfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from textloom.functions.paths import sanitize_path
from textloom.operators import members as by_position
from textloom.operators.members import STEP, Damaged, Member

from . import shared

MEMBERS = "archive string, position bigint, entry string, size bigint, content binary, error string"
_MEMBERS = pa.schema([("archive", pa.string()), ("position", pa.int64()), ("entry", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
RANGES = "archive string, start bigint, first bigint, after bigint"
_RANGES = pa.schema([("archive", pa.string()), ("start", pa.int64()), ("first", pa.int64()), ("after", pa.int64())])
#: Kinds by suffix.
SUFFIXES = {"zip": "zip", "jar": "zip", "war": "zip", "tar": "tar"}
PART_BYTES, ENTRY_BYTES, BATCH_BYTES = 64 << 20, 256 << 20, 8 << 20
#: Parts for each core where their size is left open.
TASKS = 8
#: Bytes and entries after which a task begins another archive.
FILE_BYTES, FILE_ENTRIES = 1 << 30, 100_000


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), posixpath.abspath(path))


def _found(path: str, kind: str | None) -> list[tuple[str, str, int]]:
    """Path, kind and size of each archive, in order of paths. Names that begin with a dot or an underscore are no data."""
    store, top = store_of(path)
    prefix = path[: -len(top)] if path.endswith(top) else re.match(r"^[a-z0-9]+://", path)[0] if "://" in path and not path.startswith("file:") else ""
    info = store.get_file_info(top)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [info] if info.type == fs.FileType.File else [i for i in store.get_file_info(fs.FileSelector(top, recursive=True)) if i.type == fs.FileType.File]
    out = []
    for i in sorted(files, key=lambda i: i.path):
        below = posixpath.relpath(i.path, top).split("/") if i.path != top else []
        one = kind or SUFFIXES.get(i.base_name.rsplit(".", 1)[-1].lower())
        if one and not any(p.startswith((".", "_")) and p != "." for p in below):
            out.append((prefix + i.path, one, i.size))
    return out


def opened(path: str) -> io.BufferedReader:
    """A file of any store that ``pyarrow.fs`` knows, to be read anywhere."""
    store, place = store_of(path)
    return io.BufferedReader(store.open_input_file(place), STEP)


@dataclass
class Part(InputPartition):
    """A range of an archive, or what is wrong with it."""

    archive: str
    kind: str
    size: int
    first: int = 0
    end: int = 0
    error: str | None = None


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind = options["path"], options.get("kind")
        self.part_bytes, self.entry_bytes = (int(options.get(k, d)) for k, d in (("partBytes", PART_BYTES), ("entryBytes", ENTRY_BYTES)))
        self.content = str(options.get("content", "true")).lower() != "false"
        self.guesses = {a: {int(k): tuple(v) for k, v in g.items()} for a, g in json.loads(options.get("tarGuesses", "{}")).items()}
        # ranges of a tar begin at blocks
        self.part_bytes = max(by_position.BLOCK, self.part_bytes // by_position.BLOCK * by_position.BLOCK)

    def partitions(self) -> list[Part]:
        # the reader goes to each task after this, so what is for planning only stays here
        guesses, self.guesses = self.guesses, {}
        out = []
        for path, kind, size in _found(self.path, self.kind):
            with opened(path) as f:
                try:
                    if kind == "zip":
                        parts = by_position.zip_parts(f, size, self.part_bytes)
                    else:
                        parts = by_position.tar_parts(f, size, guesses.get(path, {}), self.part_bytes)
                    out += [Part(path, kind, size, a, b) for a, b in parts]
                except Damaged as e:
                    out += self._before(path, kind, size, e)
        return out

    @staticmethod
    def _before(path: str, kind: str, size: int, e: Damaged) -> list[Part]:
        """A damaged directory: what comes before the damage is a part, whose task tells the damage where it meets it."""
        if e.position is None:
            return [Part(path, kind, size, error=str(e))]
        with opened(path) as f:
            try:
                first, end, _ = by_position.zip_directory(f, size)
            except Damaged:
                return [Part(path, kind, size, error=str(e))]
        return [Part(path, kind, size, first, end)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for m in self._rows(part):
            rows.append((part.archive, m.position, m.name, m.size, m.content, m.error))
            held += len(m.content or b"") + 256
            if held >= BATCH_BYTES:
                yield _batch(rows, _MEMBERS)
                rows, held = [], 0
        if rows:
            yield _batch(rows, _MEMBERS)

    def _rows(self, part: Part) -> Iterator[Member]:
        if part.error:
            yield Member(None, None, None, None, part.error)
            return
        with opened(part.archive) as f:
            try:
                if part.kind == "zip":
                    yield from by_position.zip_members(f, part.size, part.first, part.end, self.entry_bytes, self.content)
                else:
                    yield from by_position.tar_members(f, part.first, part.end, self.entry_bytes, self.content)
            except Damaged as e:
                yield Member(e.position, None, None, None, str(e))


class RangeReader(DataSourceReader):
    """Guesses of where the first header of each range of a tar lies."""

    def __init__(self, options):
        self.path, self.kind = options["path"], options.get("kind")
        self.part_bytes = ArchiveReader(options).part_bytes

    def partitions(self) -> list[Part]:
        found = [x for x in _found(self.path, self.kind) if x[1] == "tar"]
        return [Part(path, kind, size, start, start + self.part_bytes) for path, kind, size in found for start in range(0, size, self.part_bytes)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        with opened(part.archive) as f:
            guess = by_position.tar_guess(f, part.first, min(part.end, part.size))
        if guess:
            yield _batch([(part.archive, part.first, *guess)], _RANGES)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class ArchiveWriter(DataSourceArrowWriter):
    """Each task writes archives into a folder of this write; they are moved to their place when all are done."""

    def __init__(self, options, overwrite: bool):
        self.path, self.kind, self.overwrite = options["path"], options.get("kind", "zip"), overwrite
        if self.kind not in SUFFIXES.values():
            raise ValueError(f"unknown kind {self.kind}")
        self.most_bytes, self.most_entries = (int(options.get(k, d)) for k, d in (("fileBytes", FILE_BYTES), ("fileEntries", FILE_ENTRIES)))
        self.folder = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, top = store_of(self.path)
        store.create_dir(f"{top}/{self.folder}", recursive=True)
        context = TaskContext.get()
        names, out, sink, size, n = [], None, None, 0, 0
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("entry", "content")]
            for entry, content in zip(*(c.to_pylist() for c in columns), strict=True):
                if out is None:
                    names.append(f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{len(names):03d}.{self.kind}")
                    sink = store.open_output_stream(f"{top}/{self.folder}/{names[-1]}")
                    out, size, n = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) if self.kind == "zip" else tarfile.open(fileobj=sink, mode="w|"), 0, 0
                data = bytes(content or b"")
                if self.kind == "zip":
                    out.writestr(zipfile.ZipInfo(entry), data, zipfile.ZIP_DEFLATED)
                else:
                    info = tarfile.TarInfo(entry)
                    info.size = len(data)
                    out.addfile(info, io.BytesIO(data))
                size, n = size + len(data), n + 1
                if size >= self.most_bytes or n >= self.most_entries:
                    out.close()
                    sink.close()
                    out = None
        if out is not None:
            out.close()
            sink.close()
        return Written(names)

    def commit(self, messages) -> None:
        store, top = store_of(self.path)
        store.create_dir(top, recursive=True)
        if self.overwrite:
            for i in store.get_file_info(fs.FileSelector(top)):
                if i.base_name != self.folder:
                    store.delete_dir(i.path) if i.type == fs.FileType.Directory else store.delete_file(i.path)
        for name in (n for m in messages if m for n in m.names):
            store.move(f"{top}/{self.folder}/{name}", f"{top}/{name}")
        self._leave(store, top)

    def abort(self, messages) -> None:
        self._leave(*store_of(self.path))

    def _leave(self, store, top: str) -> None:
        if store.get_file_info(f"{top}/{self.folder}").type == fs.FileType.Directory:
            store.delete_dir(f"{top}/{self.folder}")


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options, overwrite)


class RangeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_ranges"

    def schema(self) -> str:
        return RANGES

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)
    spark.dataSource.register(RangeSource)


class _Loader:
    """Reads of one path, which share what tasks guessed about its tars."""

    def __init__(self, spark: SparkSession, path: str, part_bytes: int, entry_bytes: int, kind: str | None):
        register(spark)
        self.spark, self.path = spark, path
        self.options = {"partBytes": str(part_bytes), "entryBytes": str(entry_bytes), **({"kind": kind} if kind else {})}
        guesses: dict[str, dict[int, tuple[int, int]]] = {}
        if any(k == "tar" for _, k, _ in _found(path, kind)):
            for r in spark.read.format("archive_ranges").options(**self.options).load(path).collect():
                guesses.setdefault(r.archive, {})[r.start] = (r.first, r.after)
        self.options["tarGuesses"] = json.dumps(guesses)

    def load(self, content: bool) -> DataFrame:
        return self.spark.read.format("archive").options(**self.options, content=str(content)).load(self.path)


def even_part_bytes(spark: SparkSession, path: str, least: int, kind: str | None = None, most: int = PART_BYTES) -> int:
    """Bytes of a part such that each core has some ``TASKS`` parts of the archives below a path, within bounds: so tasks, whose start costs, grow with the
    archives' bytes only beyond ``most`` a part."""
    total = sum(size for _, _, size in _found(path, kind))
    return min(most, max(least, total // (TASKS * spark.sparkContext.defaultParallelism)))


def members(spark: SparkSession, path: str, part_bytes: int = PART_BYTES, entry_bytes: int = ENTRY_BYTES, kind: str | None = None, content: bool = True) -> DataFrame:
    """Rows of all files of the archives below a path, an archive being read by as many tasks as it has parts.

    Where there are tars, one job guesses the first header of each range (a row for each ``part_bytes`` comes to the driver).
    """
    return _Loader(spark, path, part_bytes, entry_bytes, kind).load(content)


def files(spark: SparkSession, path: str, part_bytes: int = PART_BYTES, entry_bytes: int = ENTRY_BYTES, kind: str | None = None) -> DataFrame:
    """:func:`members` with ``path``, their resolved path below the archive's root; a later member of a path replaces the earlier ones.

    What is replaced is found in the names alone, by a first pass that reads no contents; contents are shuffled only if so
    many are replaced that their positions cannot be broadcast.
    """
    loader = _Loader(spark, path, part_bytes, entry_bytes, kind)
    named = lambda df: df.withColumn("path", sanitize_path(F.col("entry"))).where("path IS NULL OR path <> ''")
    names = named(loader.load(False)).where("path IS NOT NULL").select("archive", "path", "position")
    last = names.groupBy("archive", "path").agg(F.max("position").alias("last"), F.count("*").alias("n")).where("n > 1")
    old = shared.stored(names.join(last, ["archive", "path"]).where("position < last").select("archive", "position"), "replaced")
    found = named(loader.load(True))
    return found if old.isEmpty() else found.join(old, ["archive", "position"], "left_anti")
