"""Cutting a plan's lineage in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, from spark.checkpoint.dir. Only a local master may do without the setting."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = os.path.join(tempfile.gettempdir(), "larkspur-checkpoints")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
