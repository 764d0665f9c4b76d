"""Intermediate results that outlive a lost executor: checkpoints in the folder all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Takes the folder from `spark.checkpoint.dir`. Only a local session without one gets a scratch folder; a cluster must name its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoints-")
    sc.setCheckpointDir(named)


def durable(df: DataFrame) -> DataFrame:
    """Works `df` out once, into the shared checkpoint folder, and cuts its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
