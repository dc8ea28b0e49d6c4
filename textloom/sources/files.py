"""Files in and text out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from textloom.functions import filetypes

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def scan(spark: SparkSession, path: str, recursive: bool = True, suffixes: list[str] | None = None) -> DataFrame:
    """Rows of Spark's binary file source. Suffixes prune the listing; a census that selects no content reads none."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if suffixes:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}" if len(suffixes) > 1 else f"*.{suffixes[0]}")
    return reader.load(path)


def in_walk_order(files: DataFrame) -> DataFrame:
    """Files in the order of a walk through folders: by the parts of their paths."""
    return files.orderBy(F.split("path", "/"))


def spread(files: DataFrame, partitions: int) -> DataFrame:
    """Files dealt out by a hash of their paths, so that a folder of large ones is not one task."""
    return files.repartitionByRange(partitions, F.xxhash64("path"))


def census(files: DataFrame) -> DataFrame:
    """Number and bytes of files by type, from the listing alone."""
    code = filetypes.detect_type(F.col("path"))
    return files.select(code.alias("file_type"), filetypes.type_class(code).alias("class"), "length").groupBy("file_type", "class").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def write(extracted: DataFrame, path: str, mode: str = "errorifexists") -> dict[str, int]:
    """Extracted text as Parquet, a folder for each class of types, and what was written.

    The metrics are observed while the rows pass to the sink, so nothing is read a second time: files, bytes of text and errors, in all and by
    class (``files_text``, ``bytes_text``, ``errors_text`` and so on). A task that runs again counts once.
    """
    seen = Observation()
    each = {"": F.lit(True), **{f"_{c}": F.col("class") == c for c in sorted({filetypes.class_of(t) for t in (*filetypes.TYPES.values(), filetypes.UNKNOWN)})}}
    metrics = []
    for suffix, here in each.items():
        metrics += [F.count_if(here).alias(f"files{suffix}"), F.coalesce(F.sum(F.when(here, F.col("size"))), F.lit(0)).alias(f"bytes{suffix}"), F.count_if(here & F.col("error").isNotNull()).alias(f"errors{suffix}")]
    extracted.observe(seen, *metrics).write.mode(mode).partitionBy("class").parquet(path)
    return seen.get
