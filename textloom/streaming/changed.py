"""Files that are changed in place: the text of each version, once.

State is a row a path, of its last version given: its time, its length and how many versions there have been. Only names pass the shuffle by path;
a version's bytes are read after it, in the task that has found it to be new.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from textloom.operators.registry import Registry
from textloom.plans.extract import extract_documents
from textloom.sources import versions

#: Fixed value: the only store of state that keyed processors work with.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NEWEST = "path string, modificationTime timestamp, length bigint, version bigint"
#: As processed: times are microseconds, which are compared alike in rows and in state.
_NEWEST = "path string, micros bigint, length bigint, version bigint"
_READ = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("version", pa.int64()), ("content", pa.binary())])


class _Newest(StatefulProcessor):
    """Of each path the versions that are later than, or as late and longer than, what was given before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "micros bigint, length bigint, version bigint")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        seen = sorted({(r.micros, r.length) for r in rows})
        last = self.last.get() or (None, None, 0)
        before = version = last[2]
        for micros, length in seen:
            if last[0] is None or (micros, length) > tuple(last[:2]):
                version += 1
                last = (micros, length, version)
                yield Row(path=key[0], micros=micros, length=length, version=version)
        if version > before:
            self.last.update(last)

    def close(self) -> None:
        pass


def keyed_session(spark: SparkSession) -> SparkSession:
    """A session whose streams can keep state by key; the caller's settings stay as they are."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        if value := spark.conf.get(name, None):
            own.conf.set(name, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return own


def newest_versions(found: DataFrame) -> DataFrame:
    """path, modificationTime, length, version (from 1) for each version in a stream of sightings (path, modificationTime, length), once.

    A sighting that is not later than what its path had is dropped; of several in one batch each is a version, in order of time. Of two
    with one time the longer is the later. Sightings without a path, time or length are dropped; other columns are ignored.
    """
    rows = found.select("path", F.unix_micros("modificationTime").alias("micros"), "length").where("path is not null and micros is not null and length is not null")
    new = rows.groupBy("path").transformWithState(_Newest(), _NEWEST, "Append", "None")
    return new.select("path", F.timestamp_micros("micros").alias("modificationTime"), "length", "version")


def with_content(found: DataFrame) -> DataFrame:
    """The bytes of versions, a file at a time. A version that was replaced before it could be read is left out: what replaced it is in a later batch."""

    def run(batches):
        for b in batches:
            for path, time, version in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                data = versions.content_of(path, time)
                if data is not None:
                    yield pa.RecordBatch.from_pylist([{"path": path, "modificationTime": time, "version": version, "content": data}], _READ)

    return found.select("path", "modificationTime", "version").mapInArrow(run, "path string, modificationTime timestamp, version bigint, content binary")


def extract_changed(spark: SparkSession, path: str, out: str, checkpoint: str, registry: Registry | None = None, slack_seconds: float = versions.SLACK_SECONDS) -> StreamingQuery:
    """Extract each file that is new or has changed since the last call, as Parquet, then stop.

    Rows have the columns of ``extract_documents`` and modificationTime and version; the text of a file as it is now is the row of its greatest
    version. The log of the sink and the state make a version one row, also after a failure. An error of the store fails the task.
    """
    own = keyed_session(spark)
    versions.register(own)
    seen = own.readStream.format("file_versions").option("slackSeconds", slack_seconds).load(path)
    texts = extract_documents(with_content(newest_versions(seen)), registry=registry, keep=("modificationTime", "version"))
    return texts.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
