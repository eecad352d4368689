"""Cutting lineage between the rounds of an iteration."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset, the context's checkpoint folder is taken; without one, a single-machine session gets a
    temporary folder, and a cluster's session an error, as its executors don't share local folders.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = context._jsc.sc().getCheckpointDir()
        if current.isEmpty():
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="hopwise-"))
            current = context._jsc.sc().getCheckpointDir()
        folder = current.get()
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed to the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = shared_folder(df.sparkSession)
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(folder)
    return df.checkpoint()
