"""Outputs: report sections, event logs and resumable encodings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _plain(path: str) -> str:
    return path.removeprefix("file://").rstrip("/")


def write_report(sections: dict[str, DataFrame], folder: str, inputs: tuple[str, ...] = (), kind: str = "json") -> list[str]:
    """Each section as a table under folder (S11). A folder that is, holds or lies in an input is refused, and so is one that
    exists (S12): the committer makes a section visible as a whole or not at all."""
    for source in inputs:
        a, b = _plain(source) + "/", _plain(folder) + "/"
        if a.startswith(b) or b.startswith(a):
            raise ValueError(f"{folder} would overwrite the input {source}")
    paths = []
    for name, df in sections.items():
        paths.append(f"{folder.rstrip('/')}/{name}")
        df.write.mode("errorifexists").format(kind).save(paths[-1])
    return paths


def append_events(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A stream's rows appended to a table, each once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def encode_missing(rows: DataFrame, path: str, encode: Callable[[DataFrame], DataFrame], id_col: str = "id") -> int:
    """Rows whose id the table at path lacks are encoded and appended (S14); how many they were. A run that was stopped goes on
    where it was, since what was committed isn't encoded again."""
    spark = rows.sparkSession
    try:
        done = spark.read.parquet(path).select(F.col(id_col).alias("_done")).distinct()
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        todo = rows
    else:
        todo = rows.join(done, rows[id_col] == done["_done"], "left_anti")
    n = todo.count()
    if n:
        encode(todo).write.mode("append").parquet(path)
    return n


def hashed_embedding(text: Column, dims: int = 16) -> Column:
    """A stand-in for a model's vector (R25): signed counts of hashed tokens, of unit length, zeros without tokens."""
    tokens = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    each = lambda i: F.aggregate(F.filter(tokens, lambda t: (t != "") & (F.pmod(F.xxhash64(t), F.lit(dims)) == i)), F.lit(0.0), lambda a, t: a + F.when(F.xxhash64(t, F.lit(1)) % 2 == 0, 1.0).otherwise(-1.0))
    raw = F.array(*[each(i) for i in range(dims)])
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(raw, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))
