"""The folder that every executor of the cluster can read and write."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="framewright-")


def _run_folder(spark: SparkSession) -> str:
    """The folder of this application below the cluster's `spark.checkpoint.dir`.

    Only a local session without that setting (a test) falls back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        root = _local_root()
    return f"{root.rstrip('/')}/framewright/{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder of this application's shared folder."""
    return f"{_run_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete all that this application has written to its shared folder, once its results are kept elsewhere.

    Results that have not been written yet read from there, so this is for the end of a job.
    """
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_run_folder(spark))
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def materialise(df, purpose: str):
    """Cut the lineage with a written table in the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
