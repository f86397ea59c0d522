"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints.  One of our own only where
    none is set and driver and tasks are one process, as in tests."""
    ctx = spark.sparkContext
    base = ctx.getConf().get("spark.checkpoint.dir")
    if base is None and not ctx._jsc.sc().getCheckpointDir().isEmpty():
        base = ctx._jsc.sc().getCheckpointDir().get()
    if base is None and ctx.master != "local" and not ctx.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (base or "/tmp/siltstone-checkpoints").rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    ctx = df.sparkSession.sparkContext
    if ctx._jsc.sc().getCheckpointDir().isEmpty():
        ctx.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
