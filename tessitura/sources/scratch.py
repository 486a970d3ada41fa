"""Tables and checkpoints between steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def run_folder(spark: SparkSession) -> str:
    """Where this application's tables go: under spark.checkpoint.dir, which a cluster must set to a folder that all share.

    Where it is unset a local session (tests) has a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="tessitura-"))
        base = _OWN[0]
    return f"{base.rstrip('/')}/tessitura/{spark.sparkContext.applicationId}"


def folder(spark: SparkSession, label: str) -> str:
    """A new path in the run's folder."""
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` returned and that nothing reads any more."""
    if at := getattr(df, "_stored_at", None):
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def cleanup(spark: SparkSession) -> None:
    """Delete all that this application stored. Results read stored tables lazily: call it when they are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
