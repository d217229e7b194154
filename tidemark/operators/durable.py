"""The folder that the cluster shares, and lineage cut with files in it."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster's driver and executors share.

    A local session that names none, as in tests, gets a folder of its own that
    goes when the driver ends; on a cluster that is an error.
    """
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        at = "file://" + folder
    if not context.getCheckpointDir():
        context.setCheckpointDir(at)
    return at


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with files that outlive any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
