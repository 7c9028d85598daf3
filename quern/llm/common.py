"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009 to U+000D. bytes.split() without arguments splits on exactly these.
SEPARATORS = " \t\n\v\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: spark.checkpoint.dir, or where that is unset a folder of the
    warehouse. In local mode alone, where one machine does all, a warehouse that was never set is replaced by a temporary
    folder; on a cluster one of the two settings must name a shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local"):
            base = "file://" + tempfile.mkdtemp(prefix="quern-")
        elif spark.sparkContext.getConf().get("spark.sql.warehouse.dir"):
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quern"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, is computed once."""
    path = new_dir(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What workers remember from task to task. They are shared by all stages, so one that needs the room calls forget().
REMEMBERED: list = []


def trim() -> None:
    """Gives free memory back to the system: what Arrow's pool and the C library keep for later."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if release:
        release(0)


def forget() -> None:
    """Gives back what earlier stages left in this worker."""
    for clear in REMEMBERED:
        clear()
    trim()


#: Lists of keys up to this many rows (some dozen bytes each) are broadcast; beyond it Spark shuffles.
BROADCAST_ROWS = 300_000


def small(df: DataFrame, tag: str) -> DataFrame:
    """df staged and counted, marked for broadcast if it has at most BROADCAST_ROWS rows."""
    df = staged(df, tag)
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def row_key(id_col: Column, text_col: Column) -> list[Column]:
    """Two hash columns (96 bits) that name a row by its id and text; repeated rows share them."""
    return [F.xxhash64(id_col, text_col).alias("_rk"), F.hash(text_col, id_col).alias("_rk2")]


def text_rows(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small slices, so that what is made of a batch of long texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
