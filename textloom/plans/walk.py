"""Archives of any size as rows: the files in them, and their folded text by offsets.

:func:`walk` reads each archive in parts, in as many tasks as it has parts; an archive within an archive is one member and is
expanded within its row. :func:`fold_offsets` lays the rows out in walk order, each with the byte at which it starts in the
folded text, so that nothing has to hold the text of a whole archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import filetypes
from textloom.operators.archive import BLOCK, KINDS
from textloom.operators.registry import Registry
from textloom.sources import archives, shared

from .extract import archive_entries, extract_documents

_ARCHIVES = [code for code, kind in filetypes.EXTRACTORS.items() if kind in KINDS]
_BEFORE, _BETWEEN, _AFTER = BLOCK.split("{}")


def walk(spark: SparkSession, path: str, part_bytes: int = archives.PART_BYTES, entry_bytes: int = archives.ENTRY_BYTES, kind: str | None = None, registry: Registry | None = None) -> DataFrame:
    """archive, entry_path (a part for each level), file_type, text, size, method, error of all files of the archives below a path.

    What cannot be read is a row with its error; damage of an archive is a row of it without an entry_path.
    """
    own = registry or Registry()
    found = archives.files(spark, path, part_bytes, entry_bytes, kind)
    is_inner = F.coalesce(filetypes.detect_type(F.col("path")).isin(_ARCHIVES), F.lit(False)) & F.col("error").isNull()
    read = extract_documents(found.where(~is_inner), registry=own, keep=("archive", "error"))
    # the error that came with a member goes before what extraction says of its missing content
    read = read.toDF("archive", "damage", *read.columns[2:])
    leaves = read.select("archive", F.when(F.col("path").isNotNull(), F.array("path")).alias("entry_path"), "file_type", "text", "size", "method", F.coalesce("damage", "error").alias("error"))
    return leaves.unionByName(_inner(found.where(is_inner), own))


def _inner(found: DataFrame, own: Registry) -> DataFrame:
    """Files of archives that are members themselves. No path of a file holds a NUL, so the first one ends the outer archive's."""
    mark = "\0/"
    rows = archive_entries(found.select(F.concat("archive", F.lit(mark), "path").alias("path"), "content"), registry=own)
    outer = F.substring_index("path", mark, 1)
    name = F.substring("path", F.char_length(outer) + len(mark) + 1, F.char_length("path"))
    # an inner archive that cannot be opened is a file without text; damage within it has a path that ends in the empty part
    inner = F.coalesce("entry_path", F.array().cast("array<string>"))
    return rows.select(outer.alias("archive"), F.concat(F.array(name), inner).alias("entry_path"), "file_type", "text", "size", "method", "error")


def _place(levels: Column) -> Column:
    """Sorts as a walk meets files: level by level, by parts of paths. What closes an archive comes after all in it."""
    return F.transform(levels, lambda x: F.struct(F.lit(0).alias("close"), F.split(x, "/").alias("parts")))


def fold_offsets(entries: DataFrame, by: str = "archive", levels: str = "entry_path", text: str = "text") -> DataFrame:
    """by, levels, offset, length, block: the pieces of each archive's folded text, and where each starts in it, in bytes.

    A file's piece is its block. An archive within an archive adds a piece before its first file and one after its last. Pieces that
    are put together by offset are what the fold of the whole gives.

    Two passes: rows are laid out in walk order by range, whatever archive they belong to, and stored; lengths are summed up for each
    archive and partition; a partition then counts on from what the partitions before it hold of its first archive. Only that
    is broadcast, a row for each partition at most. So one archive that has all rows is still many tasks.
    """
    spark = entries.sparkSession
    found = entries.where(F.element_at(levels, -1) != "").select(F.col(by).alias("by"), F.col(levels).alias("levels"), F.coalesce(text, F.lit("")).alias("text"))
    last = F.element_at("levels", -1)
    files = found.select("by", "levels", _place(F.col("levels")).alias("place"), F.concat(F.lit(_BEFORE), last, F.lit(_BETWEEN), "text", F.lit(_AFTER)).alias("block"))
    above = F.transform(F.sequence(F.lit(1), F.size("levels") - 1), lambda n: F.slice("levels", F.lit(1), n))
    inner = found.where(F.size("levels") > 1).select("by", F.explode(above).alias("levels")).distinct()
    opened = inner.select("by", "levels", _place(F.col("levels")).alias("place"), F.concat(F.lit(_BEFORE), last, F.lit(_BETWEEN)).alias("block"))
    end = F.array(F.struct(F.lit(1).alias("close"), F.array().cast("array<string>").alias("parts")))
    closed = inner.select("by", "levels", F.concat(_place(F.col("levels")), end).alias("place"), F.lit(_AFTER).alias("block"))
    rows = files.unionByName(opened).unionByName(closed)
    laid = rows.repartitionByRange("by", "place").sortWithinPartitions("by", "place").select("*", F.octet_length("block").cast("bigint").alias("length"), F.spark_partition_id().alias("part"))
    laid = shared.stored(laid, "fold")
    totals = laid.groupBy("by", "part").agg(F.sum("length").alias("total"))
    so_far = Window.partitionBy("by").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("by", "part", F.sum("total").over(so_far).alias("carried")).where("carried IS NOT NULL").toDF("in", "at", "carried")
    within = Window.partitionBy("part", "by").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    started = laid.withColumn("before", F.coalesce(F.sum("length").over(within), F.lit(0)))
    # an archive goes on from the partition before in one archive a partition only, so this is at most a row a partition
    both = started.join(F.broadcast(carried), (F.col("part") == F.col("at")) & F.col("by").eqNullSafe(F.col("in")), "left")
    return both.select(F.col("by").alias(by), F.col("levels").alias(levels), (F.col("before") + F.coalesce("carried", F.lit(0))).alias("offset"), "length", "block")
