"""Where intermediate tables are kept."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only in a local session where it is unset, as in tests, a temporary folder takes its place;
    elsewhere executors couldn't see such a folder, and a missing setting raises."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quillsift-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
