"""Cutting lineage in loops, and where jobs may put tables: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir.

    Where that is unset, a session on one machine takes a temporary folder, and one on a cluster a folder of the default
    file system, which executors share unless it is a local one: that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.startswith("local"):
            base = tempfile.mkdtemp(prefix="spark-shared-")
        else:
            home = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration()).getHomeDirectory()
            if home.toUri().getScheme() == "file":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = f"{home}/spark-shared"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/orderflow-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()
