"""The folder that driver and executors share, for what is written between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, set as the session's checkpoint folder; where it is unset, a temporary one in local mode only."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/scan-{uuid.uuid4().hex}"
