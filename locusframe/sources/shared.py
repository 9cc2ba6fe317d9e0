"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What the session names in spark.checkpoint.dir. Without one, a temporary folder, but only where all tasks run in this process's machine."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(top)
        top = spark.sparkContext.getCheckpointDir()
    return top.rstrip("/")


#: Paths that this process has named, until clear() deletes them.
_named: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. Tables are lazy, so what lies there is deleted by clear(), not when a function returns."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _named.append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Delete everything that this process has put into the shared folder, once its results are written elsewhere. Returns how many paths there were."""
    n = len(_named)
    while _named:
        base = _named.pop()
        for name in (base, f"{base}-state"):
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
