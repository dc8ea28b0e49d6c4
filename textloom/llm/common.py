"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_temporary: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none (a local session, as in tests) a temporary one is made.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir() or _temporary.get(sc.applicationId)
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = _temporary[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="textloom-")
        removed_at_end(spark, found)
    return found


def removed_at_end(spark: SparkSession, path: str) -> None:
    """Make a folder that is deleted when the driver's JVM ends, also after ``spark.stop()``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)


_homes: dict[tuple[str, str], str] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing has, in this driver's part of the shared folder."""
    shared = shared_dir(spark).rstrip("/")
    key = (spark.sparkContext.applicationId, shared)
    if key not in _homes:
        _homes[key] = f"{shared}/textloom-{uuid.uuid4().hex}"
        removed_at_end(spark, _homes[key])
    return f"{_homes[key]}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, reader: SparkSession | None = None) -> DataFrame:
    """Compute now and cut the lineage, by compressed Parquet in the shared folder.

    Later reads, also after lost executors, find the table until :func:`dropped` or the end of the driver removes it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = (reader or spark).read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def cut(df: DataFrame) -> DataFrame:
    """A small table by :func:`stored`."""
    return stored(df, "cut")


def dropped(*tables: DataFrame | None) -> None:
    """Remove the files of tables made by :func:`stored` once nothing reads them any more."""
    for df in tables:
        if path := getattr(df, "stored_path", None):
            spark = df.sparkSession
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            df.stored_path = None


def with_settings(df: DataFrame, **settings) -> DataFrame:
    """The same rows under settings of their own; the caller's session keeps its settings."""
    jvm = df.sparkSession._jvm
    session = SparkSession(df.sparkSession.sparkContext, df.sparkSession._jsparkSession.cloneSession())
    for key, value in settings.items():
        session.conf.set(key, value)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, df._jdf.logicalPlan()), session)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _c_library():
    library = ctypes.CDLL(None)
    return library if hasattr(library, "mallopt") and hasattr(library, "malloc_trim") else None


def frugal(run, block: int | None = 1 << 20):
    """A function over batches whose worker gives memory back to the system.

    Workers wait for later tasks of other stages, and what they keep counts against the executor. Blocks of a MiB or more go back
    as soon as they are free (the C library's own limit grows to 32 MiB, so that batches would stay), the rest when
    a task is done. With another ``block``, or None for the library's own rule, less goes back and less time goes into it. Other C libraries are left as they are.
    """

    def wrapped(batches):
        library = _c_library()
        if library and block:
            library.mallopt(-3, block)  # M_MMAP_THRESHOLD
            library.mallopt(-8, 1)  # M_ARENA_MAX
            pa.set_memory_pool(pa.system_memory_pool())
        yield from run(batches)
        if library:
            library.malloc_trim(0)

    return wrapped


def bytes_of(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(n)
