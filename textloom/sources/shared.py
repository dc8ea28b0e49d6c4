"""Tables and folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing has, below ``spark.checkpoint.dir``; removed when the driver's JVM ends.

    Where a local session, as in tests, names no such folder a temporary one is made.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _folders:
        top = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
        if not top and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        home = f"{top.rstrip('/')}/textloom-files-{uuid.uuid4().hex}" if top else "file://" + tempfile.mkdtemp(prefix="textloom-")
        path = sc._jvm.org.apache.hadoop.fs.Path(home)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _folders[sc.applicationId] = home
    return f"{_folders[sc.applicationId]}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Compute now and cut the lineage by a Parquet table in the shared folder."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
