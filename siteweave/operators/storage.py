"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, a new temporary folder if the master is local.

    On a cluster a temporary folder wouldn't be shared, so a missing setting is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-siteweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stable(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint: what is derived from it twice sees the same rows and partitions."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
