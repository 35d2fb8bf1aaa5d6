"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir. One of our own is set only where it is unset and all executors run in this process, as in tests; elsewhere that is an error."""
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if known is None:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="memspark-checkpoint-")
        context.setCheckpointDir(known)
    return known


def durable(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and returns it with its lineage cut; lost executors don't lose it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
