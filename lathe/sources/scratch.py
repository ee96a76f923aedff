"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all run on this machine, a new local folder."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lathe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The same rows, read back from Parquet."""
    path = f"{shared_folder(spark)}/lathe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _PATHS[back] = path
    return back


_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def forget(df: DataFrame) -> None:
    """Deletes what written() left for these rows, which nothing may read any more; other rows are left alone."""
    path = _PATHS.pop(df, None)
    if path is not None:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def local_folder(spark: SparkSession) -> str:
    """A new folder below the shared one, which must be on a mounted file system, as a plain path."""
    folder = shared_folder(spark)
    if "://" in folder and not folder.startswith("file:"):
        raise ValueError(f"{folder} is not on a mounted file system")
    path = f"/{folder.removeprefix('file:').lstrip('/')}/lathe-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path
