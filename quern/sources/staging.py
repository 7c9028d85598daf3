"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a temporary folder in local mode, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """df to be joined in tasks, whatever its files' size: packed files don't tell how large the rows are, and what is broadcast
    goes whole through the driver."""
    return df.hint("shuffle_hash")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written once and read back: what several steps use isn't computed again, and a lost executor loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
