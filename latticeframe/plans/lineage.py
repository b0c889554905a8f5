"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset: a new temporary folder under a local master (tests), and an
    error on a cluster, whose executors would each write to a folder of their own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        held = spark.sparkContext.getCheckpointDir()
    return held


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: later uses neither recompute it nor depend on an executor that is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, name: str, most: int = 100_000) -> DataFrame:
    """A table to join with a large one: written, counted, and broadcast only where it has no more than `most` rows."""
    table = materialise(df, name)
    return F.broadcast(table) if table.count() <= most else table
