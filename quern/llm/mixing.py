"""Mixing sources to target weights by Poisson replication.

The repetition rate of a source is its target share of the characters divided by its present share. Each document is
repeated as often as the inverse Poisson distribution with that mean says for a uniform number hashed from the seed and
the document's id, so the mixture is unbiased, needs no coordination and is the same on every run. Rates above
PIECE are split into equal parts with a hash each (a sum of Poisson variables is Poisson), so nothing underflows.

Defined results: a null source is a source of its own; a null or empty text has zero characters but is replicated like
the others of its source; sources without characters keep rate 1; rows with equal ids get equal counts (the hash takes
the id); an empty table gives an empty result; other columns are carried along, whatever their names, but
those called copy_no and order_key are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import staged, table

SEED = 20240607
#: Largest mean inverted at once, and the number of steps that hold its distribution to the last bit of a double.
PIECE, STEPS = 16, 90
#: Up to this many sources (a kilobyte each) their table is broadcast; beyond it Spark shuffles and splits hot sources.
BROADCAST_SOURCES = 10_000
#: Default target: shares in proportion to characters to this power.
TEMPERATURE = 0.7


def _uniform(*parts) -> F.Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])), 1, 13), 16, 10).cast("double") / float(1 << 52)


def source_rates(docs: DataFrame, source_col: str = "source", text_col: str = "text", weights: dict[str, float] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """_source, rate: one row per source. weights gives target weights by source (others get none); else temperature."""
    chars = docs.groupBy(F.col(source_col).alias("_source")).agg(F.sum(F.coalesce(F.length(text_col), F.lit(0))).cast("bigint").alias("_chars"))
    if weights is None:
        target = F.pow(F.col("_chars").cast("double"), F.lit(temperature))
    else:
        target = F.lit(0.0)
        for name, weight in weights.items():
            target = F.when(F.col("_source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(target)
    chars = chars.withColumn("_target", target)
    total = chars.agg(F.sum("_chars").cast("double").alias("c"), F.sum("_target").alias("t")).first()  # one row
    rate = F.col("_target") / F.lit(total["t"] or 1.0) * F.lit(total["c"] or 0.0) / F.col("_chars")
    return chars.select("_source", F.when(F.col("_chars") > 0, rate).otherwise(F.lit(1.0)).alias("rate"))


def poisson_replicate(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """All columns of docs, repeated by the drawn counts, with copy_no (from 1) and order_key.

    The table of sources is broadcast if it is counted as small, so the texts are shuffled once: each copy goes to the
    partition that its order_key, a hash, names, and lies there by the order of it. That is a random order of all copies
    without a pass that samples keys first."""
    docs = docs.drop("copy_no", "order_key")
    rates = source_rates(docs, source_col, text_col, weights, temperature)
    mean = F.col("rate") / F.col("_pieces")
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)),
        F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all")),
        lambda a, k: F.struct((a["p"] * mean / k).alias("p"), (a["c"] + a["p"] * mean / k).alias("c"), F.array_append(a["all"], a["c"] + a["p"] * mean / k).alias("all")),
        lambda a: a["all"],
    )
    rates = rates.withColumn("_pieces", F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE)).cast("int")).withColumn("_cdf", steps).withColumnRenamed("rate", "_rate")
    rates = staged(rates.drop("_chars"), "rates")
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    # the row travels as one column, so no name of its own can clash with those used here
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[id_col].alias("_id"), docs[source_col].alias("_of"))
    uniforms = F.transform(F.sequence(F.lit(1), F.col("_pieces")), lambda j: _uniform(F.lit(seed), F.col("_id"), j))
    drawn = F.aggregate(uniforms, F.lit(0), lambda a, u: a + F.size(F.filter("_cdf", lambda c: u >= c)))
    joined = rows.join(rates, rows["_of"].eqNullSafe(rates["_source"]), "left").select("_row", "_id", drawn.alias("_count")).filter("_count > 0")
    copies = joined.select("_row", "_id", F.explode(F.sequence(F.lit(1), F.col("_count"))).alias("copy_no"))
    key = F.md5(F.concat_ws(":", F.lit("order"), F.lit(seed), F.coalesce(F.col("_id").cast("string"), F.lit("null")), "copy_no"))
    placed = copies.withColumn("order_key", key).repartition("order_key").sortWithinPartitions("order_key")
    return placed.select("_row.*", "copy_no", "order_key")


def op7_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_replicate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


OP7_SQL = f"""
WITH RECURSIVE c AS (SELECT source, sum(coalesce(length("text"), 0))::BIGINT AS chars FROM documents GROUP BY source),
r AS (SELECT source, CASE WHEN chars > 0 THEN pow(chars::DOUBLE, {TEMPERATURE}) / (SELECT sum(pow(chars::DOUBLE, {TEMPERATURE})) FROM c)
             * (SELECT sum(chars)::DOUBLE FROM c) / chars ELSE 1.0 END AS rate FROM c),
q AS (SELECT source, greatest(1, ceil(rate / {PIECE}))::BIGINT AS pieces, rate / greatest(1, ceil(rate / {PIECE})) AS mean FROM r),
p(source, pieces, mean, k, p, cdf) AS (
  SELECT source, pieces, mean, 0, exp(-mean), exp(-mean) FROM q
  UNION ALL SELECT source, pieces, mean, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM p WHERE k < {STEPS}),
l AS (SELECT source, any_value(pieces) AS pieces, list(cdf) AS cdf FROM p GROUP BY source),
n AS (SELECT d.doc_id, d.source, d."text",
        list_sum(list_transform(range(1, pieces + 1), lambda j: len(list_filter(cdf, lambda x:
          ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || j), 1, 13))::BIGINT / {1 << 52}.0 >= x)))) AS n
      FROM documents d JOIN l ON d.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, source, "text", i::INTEGER AS copy_no, md5('order:{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || i) AS order_key
FROM (SELECT *, unnest(range(1, n::BIGINT + 1)) AS i FROM n)
"""
