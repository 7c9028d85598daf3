"""The tables of the product-search domain as views over the driver's star schema. Each is one projection or join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = "Parts"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asin, title, store, category, categories, size, price, rating_number, average_rating; row_pos is the key order."""
    part, lines = read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem")
    rated = lines.groupBy(F.col("l_partkey").alias("_k")).agg(F.count("*").alias("rating_number"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("_r"))
    joined = part.join(rated, part["p_partkey"] == rated["_k"], "left")
    n = F.coalesce("rating_number", F.lit(0))
    return joined.select(
        F.col("p_partkey").alias("asin"), F.col("p_name").alias("title"), F.col("p_brand").alias("store"), F.col("p_type").alias("category"),
        F.array(F.lit(ROOT), "p_type").alias("categories"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"),
        n.alias("rating_number"), F.when(n > 0, 5 * (1 - F.col("_r") / n)).alias("average_rating"),
    )


CATALOG_SQL = f"""catalog AS (
  SELECT p_partkey AS asin, p_name AS title, p_brand AS store, p_type AS category, ['{ROOT}', p_type] AS categories, p_size AS size, p_retailprice AS price,
         coalesce(n, 0) AS rating_number, CASE WHEN n > 0 THEN 5 * (1 - r / n) END AS average_rating
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::DOUBLE AS r FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)"""


def sessions(spark: SparkSession, sf_dir: str, top: int = 10) -> DataFrame:
    """Stored evaluation outcomes: one row a turn of a user's day of events, in successive sessions of MAX_TURNS turns. A
    purchase is a hit. sample_id, scenario_type, turn, hit, rank."""
    e = read(spark, sf_dir, "events").withColumn("_day", F.date_format("ts", "yyyyMMdd"))
    place = F.row_number().over(Window.partitionBy("user_id", "_day").orderBy("ts", "event_id")) - 1
    scenario = F.element_at(F.array(*map(F.lit, SCENARIOS)), F.pmod("user_id", F.lit(len(SCENARIOS))).cast("int") + 1)
    x = e.withColumn("_place", place)
    name = F.concat_ws("-", "user_id", F.floor(F.col("_place") / MAX_TURNS), "_day")
    return x.select(name.alias("sample_id"), scenario.alias("scenario_type"), (F.col("_place") % MAX_TURNS + 1).alias("turn"), (F.col("event_type") == "purchase").alias("hit"), (F.pmod("event_id", F.lit(top)) + 1).alias("rank"))


#: Scenario names, turns of a session.
SCENARIOS, MAX_TURNS = ("buying", "browsing", "intent_override", "boundary"), 10
SESSIONS_SQL = f"""sess AS (
  SELECT user_id || '-' || (place // {MAX_TURNS}) || '-' || day AS sample_id, {list(SCENARIOS)}[user_id % {len(SCENARIOS)} + 1] AS scenario_type, place % {MAX_TURNS} + 1 AS turn, event_type = 'purchase' AS hit, event_id % 10 + 1 AS rank
  FROM (SELECT *, strftime(ts, '%Y%m%d') AS day, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y%m%d') ORDER BY ts, event_id) - 1 AS place FROM events))"""
