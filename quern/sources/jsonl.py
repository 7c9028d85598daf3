"""Readers of JSON lines: products in file order, strict rows with line numbers, gzipped reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BAD = "_bad"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value of every line of text files. A large file is read by many tasks: a line's number is its place
    in its block plus the lines of the file's earlier blocks, which one small aggregate counts."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value"
    )
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.join(offsets, ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "value")


def read_strict(spark: SparkSession, path: str, schema: StructType, required: tuple[str, ...] = (), strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows and rejects of JSON lines (S3). Blank lines are skipped. A line that is no JSON object of the schema, or lacks a
    required field, is a reject: file, line, value. Rows carry file and line. Empty files give no rows and no rejects; strict: the
    first reject, or input without a row, is an error."""
    with_bad = StructType(list(schema.fields)).add(BAD, "string")
    parsed = numbered_lines(spark, path).filter(F.trim("value") != "")
    parsed = parsed.withColumn("row", F.from_json("value", with_bad, {"columnNameOfCorruptRecord": BAD, "mode": "PERMISSIVE"}))
    bad = F.col("row").isNull() | F.col(f"row.{BAD}").isNotNull() | ~F.ltrim("value").startswith("{")
    for name in required:
        bad = bad | F.col("row")[name].isNull()
    bad = F.coalesce(bad, F.lit(True))
    good = parsed.filter(~bad).select("file", "line", *[F.col("row")[f.name].alias(f.name) for f in schema.fields])
    rejects = parsed.filter(bad).select("file", "line", "value")
    if strict:
        first = rejects.orderBy("file", "line").limit(1).collect()  # one row
        if first:
            raise ValueError(f"{first[0]['file']}:{first[0]['line']}: no row of the schema: {first[0]['value'][:80]}")
        if good.isEmpty():
            raise ValueError(f"{path}: no rows")
    return good, rejects


def read_catalog(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Products with row_pos, which grows in file order within a file and decides ties."""
    return spark.read.schema(schema).json(path).withColumn("row_pos", F.monotonically_increasing_id())


def read_reviews(spark: SparkSession, path: str, schema: StructType, partitions: int, most: int | None = None) -> DataFrame:
    """Gzipped reviews with _corrupt, the text of malformed lines (S2). A gzip file is read by one task, so lines are dealt out
    anew before they are parsed. most is the caller's own cap on rows; none by default."""
    lines = spark.read.text(path)
    lines = lines.limit(most) if most is not None else lines
    row = F.from_json("value", StructType(list(schema.fields)).add("_corrupt", "string"), {"columnNameOfCorruptRecord": "_corrupt"})
    return lines.repartition(partitions).select(row.alias("row")).select("row.*")


def strict_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type: rows, those whose properties are no object with a number k, and the sum of k (S3)."""
    row = F.from_json("props", f"k long, {BAD} string", {"columnNameOfCorruptRecord": BAD})
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", row.alias("r"))
    good = F.coalesce(F.col(f"r.{BAD}").isNull() & F.col("r.k").isNotNull(), F.lit(False))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(~good).alias("n_rejects"), F.sum(F.when(good, F.col("r.k"))).alias("k"))


STRICT_SQL = """WITH e AS (SELECT event_type, CASE WHEN json_valid(props) AND json_type(props) = 'OBJECT' THEN TRY_CAST(props::JSON ->> '$.k' AS BIGINT) END AS k FROM events)
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE k IS NULL) AS n_rejects, sum(k)::BIGINT AS k FROM e GROUP BY 1"""

QUERIES = {"strict_props": strict_props}
SQL = {"strict_props": STRICT_SQL}
