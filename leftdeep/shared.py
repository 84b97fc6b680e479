"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by a session on one machine that names no folder, as in tests.
LOCAL_DEFAULT = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, else what ``setCheckpointDir`` was given. Without
    either, a session on one machine has LOCAL_DEFAULT; a cluster has to name a folder, as its
    machines see no folder of each other."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or LOCAL_DEFAULT).rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/leftdeep/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path; whatever is written there goes when the application ends, if not before."""
    path = _own_dir(spark)
    target, files = _on_files(spark, path)
    files.mkdirs(target)
    files.deleteOnExit(target)  # of a path that exists
    return f"{path}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again, so that lost executors cost no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    target, files = _on_files(spark, path)
    files.delete(target, True)


def remove_all(spark: SparkSession) -> None:
    """Deletes every intermediate table of this application: for long sessions, between queries
    whose results have been used."""
    remove(spark, _own_dir(spark))


def _on_files(spark: SparkSession, path: str):
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(sc._jsc.hadoopConfiguration())
