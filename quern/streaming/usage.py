"""Streams of usage events and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.evaluate import _USAGE, PRICES, usage_events

#: Larger sketches are closer: the rank of a quantile is off by about 1.3 percent at 200, 0.3 percent at 1000.
SKETCH = 1000


def windowed_usage(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Turns and mean latency by window and provider; later events than the watermark are dropped."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", window), F.col("event_type").alias("provider"))
    return by.agg(F.count("*").alias("turns"), F.avg("value").alias("latency")).select(F.col("window.start").alias("start"), "provider", "turns", "latency")


def usage_sketches(events: DataFrame, window: str = "1 hour") -> DataFrame:
    """start, provider, turns, tokens, cost and a mergeable sketch of the latencies, by window (X4, A25). events: provider, ts,
    tokens, latency_ms, as a table or as a stream with a watermark on ts. The sketch has a bounded size and is added up map-side
    and across micro-batches like any sum; negative tokens count as none, providers without a price cost nothing."""
    price = F.coalesce(F.create_map(*[F.lit(x) for kv in PRICES.items() for x in kv])[F.col("provider")], F.lit(0.0))
    tokens = F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0))
    by = events.groupBy(F.window("ts", window), "provider")
    x = by.agg(F.count("*").alias("turns"), F.sum(tokens).cast("bigint").alias("tokens"), F.sum(tokens * price / 1000).alias("cost"), F.kll_sketch_agg_double("latency_ms", F.lit(SKETCH)).alias("sketch"))
    return x.select(F.col("window.start").alias("start"), "provider", "turns", "tokens", "cost", "sketch")


def quantiles(sketches: DataFrame, by: list[str], at: dict[str, float]) -> DataFrame:
    """by, n and the named quantiles of all sketches of each group, merged: windows become days, or a whole history, without
    the events (A26)."""
    merged = sketches.groupBy(*by).agg(F.sum("turns").alias("n"), F.kll_merge_agg_double("sketch").alias("s"))
    return merged.select(*by, "n", *[F.kll_sketch_get_quantile_double("s", F.lit(q)).alias(name) for name, q in at.items()])


def usage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, tokens and cost by day and provider: what usage_sketches gives of a table."""
    return usage_sketches(usage_events(spark, sf_dir), "1 day").select(F.date_format("start", "yyyyMMdd").alias("day"), "provider", "turns", "tokens", F.round("cost", 6).alias("cost"))


WINDOWS_SQL = f"""WITH {_USAGE}, w AS (SELECT split_part(session_id, '-', 2) AS day, * FROM ev)
SELECT day, provider, count(*) AS turns, sum(tokens)::BIGINT AS tokens, round(sum(tokens * CASE provider {" ".join(f"WHEN '{k}' THEN {v}" for k, v in PRICES.items())} ELSE 0 END / 1000), 6)::DOUBLE AS cost FROM w GROUP BY ALL"""


def once_per_message(messages: DataFrame, late: str = "1 day") -> DataFrame:
    """The first copy of each (session_id, message_id) within the watermark."""
    return messages.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session_id", "message_id"])


QUERIES = {"usage_windows": usage_windows}
SQL = {"usage_windows": WINDOWS_SQL}
