"""The folder that driver and executors share, and tables written there to cut lineage.

All of an application's tables lie in one folder, which goes when the application ends; what is no longer needed before
that can be released.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PATH = "_txstream_path"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; in local mode a new folder is made and set where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="txstream-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it takes it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder."""
    folder = f"{shared_dir(spark)}/txstream/{spark.sparkContext.applicationId}"
    fs, at = filesystem(spark, folder)
    if not fs.exists(at):
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back."""
    spark, schema, path = df.sparkSession, df.schema, scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    setattr(out, _PATH, path)
    return out


def released(*frames: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for frame in frames:
        removed(frame.sparkSession, getattr(frame, _PATH))


def removed(spark: SparkSession, path: str) -> None:
    fs, at = filesystem(spark, path)
    fs.delete(at, True)
