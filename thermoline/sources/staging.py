"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _root(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; a local one only where none is set and all run on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="thermoline-"))
        at = spark.sparkContext.getCheckpointDir()
    return f"{at.rstrip('/')}/thermoline-{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession) -> str:
    """A new folder name."""
    return f"{_root(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """The rows, written to the shared folder with the options of the writer, and read again.

    What several later steps read is computed once, plans stay small, and the rows outlive executors.
    """
    at = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.options(**options).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has stored; for when its results are written and no query of it runs any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_root(spark))
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
