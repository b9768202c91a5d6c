"""Cutting lineage through the shared folder that the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local run gets a folder of its own, and any other master an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is unset; on {master} it must name a folder that driver and executors share")
        d = f"file://{tempfile.gettempdir()}/tarn-checkpoints"
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from a reliable checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
