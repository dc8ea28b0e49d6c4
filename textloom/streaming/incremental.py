"""New files of a folder to text, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from textloom.operators.registry import Registry
from textloom.plans.extract import extract_documents
from textloom.sources.files import SCHEMA


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)


def extract_stream(spark: SparkSession, path: str, out: str, checkpoint: str, registry: Registry | None = None, files_per_trigger: int = 1000) -> StreamingQuery:
    """Extract what is there and not done yet, as Parquet, then stop.

    Extraction has no state, so the source's log of files and the file sink's log make each file exactly one row, also
    after a failure. A file that is changed in place is not read again.
    """
    files = read_stream(spark, path, files_per_trigger)
    return extract_documents(files, registry=registry).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
