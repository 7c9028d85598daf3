"""Category signals, budget buckets and question-value signals of candidate pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.profile import TOKENS_SQL, ranked_values
from quern.sources.views import CATALOG_SQL, catalog

#: Prior probability that a customer answers about an attribute.
PRIORS = {"color_word": 0.6, "size": 0.5, "store": 0.4}


def attribute_values(c: DataFrame) -> DataFrame:
    """asin, category, attribute, value (V6, V7): one row a present attribute value."""
    first = F.try_element_at(T.tokens(F.col("title")), F.lit(1))
    rows = F.array(*[F.struct(F.lit(n).alias("attribute"), v.alias("value")) for n, v in (("color_word", first), ("size", F.col("size").cast("string")), ("store", F.col("store")))])
    return c.select("asin", "category", F.explode(rows).alias("x")).select("asin", "category", "x.attribute", "x.value").filter("value is not null")


_VALUES_SQL = f"""val AS (SELECT asin, category, attribute, value FROM (
  SELECT asin, category, unnest([{{'attribute': 'color_word', 'value': {TOKENS_SQL.format('title')}[1]}}, {{'attribute': 'size', 'value': size::VARCHAR}}, {{'attribute': 'store', 'value': store}}], recursive := true) FROM catalog) WHERE value IS NOT NULL)"""


def category_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, normalised entropy, answer probability and information gain by category and attribute, and over all as
    __all__ (A11, A13, J4)."""
    c = catalog(spark, sf_dir)
    values = attribute_values(c).withColumn("category", F.explode(F.array("category", F.lit("__all__"))))
    totals = c.withColumn("category", F.explode(F.array("category", F.lit("__all__")))).groupBy("category").agg(F.count("*").alias("total"))
    counts = values.groupBy("category", "attribute", "value").agg(F.count("*").alias("n"))
    sums = counts.groupBy("category", "attribute").agg(F.sum("n").alias("covered"), F.count("*").alias("k"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    entropy = F.when(F.col("k") > 1, (F.log("covered") - F.col("nlogn") / F.col("covered")) / F.log("k")).otherwise(0.0)
    coverage = F.col("covered") / F.col("total")
    prior = F.create_map(*[F.lit(x) for kv in PRIORS.items() for x in kv])[F.col("attribute")]
    out = sums.join(totals, "category")
    return out.select("category", "attribute", F.round(coverage, 6).alias("coverage"), F.round(entropy, 6).alias("entropy"), F.round(F.least(F.lit(1.0), 0.7 * prior + 0.3 * coverage), 6).alias("answer_probability"), F.round(coverage * entropy, 6).alias("gain"))


CATEGORY_SIGNALS_SQL = f"""WITH {CATALOG_SQL}, {_VALUES_SQL}, v2 AS (SELECT asin, unnest([category, '__all__']) AS category, attribute, value FROM val), t AS (SELECT category, count(*) AS total FROM (SELECT unnest([category, '__all__']) AS category FROM catalog) GROUP BY 1),
n AS (SELECT category, attribute, value, count(*) AS n FROM v2 GROUP BY ALL),
s AS (SELECT category, attribute, sum(n) AS covered, count(*) AS k, sum(n * ln(n)) AS nlogn FROM n GROUP BY ALL),
e AS (SELECT category, attribute, covered / total AS coverage, CASE WHEN k > 1 THEN (ln(covered) - nlogn / covered) / ln(k) ELSE 0 END AS entropy FROM s JOIN t USING (category))
SELECT category, attribute, round(coverage, 6) AS coverage, round(entropy, 6) AS entropy, round(least(1.0, 0.7 * CASE attribute {" ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIORS.items())} END + 0.3 * coverage), 6)::DOUBLE AS answer_probability, round(coverage * entropy, 6) AS gain FROM e"""


def budget_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price quartiles by category (linear interpolation) and the bucket of each product, counted."""
    c = catalog(spark, sf_dir).filter("price is not null")
    place = lambda p: lambda n: (n - 1) * p
    ranks = {f"{name}{end}": (lambda n, p=p, f=f: f(place(p)(n)) + 1) for name, p in (("a", 0.25), ("b", 0.75)) for end, f in (("0", F.floor), ("1", F.ceil))}
    at = ranked_values(c, ["category"], "price", ranks)
    between = lambda x, p: F.col(f"{x}0") + (F.col(f"{x}1") - F.col(f"{x}0")) * (place(p)(F.col("n")) - F.floor(place(p)(F.col("n"))))
    q = at.select("category", between("a", 0.25).alias("a"), between("b", 0.75).alias("b"))
    bucket = F.when(F.col("price") <= F.col("a"), "low").when(F.col("price") <= F.col("b"), "mid").otherwise("high")
    return c.join(q, "category").groupBy("category", F.round("a", 4).alias("q25"), F.round("b", 4).alias("q75"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


BUDGET_SQL = """WITH q AS (SELECT p_type AS category, quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.75) AS b FROM part WHERE p_retailprice IS NOT NULL GROUP BY 1)
SELECT category, round(a, 4) AS q25, round(b, 4) AS q75, CASE WHEN p_retailprice <= a THEN 'low' WHEN p_retailprice <= b THEN 'mid' ELSE 'high' END AS bucket, count(*) AS n FROM part JOIN q ON p_type = category GROUP BY ALL"""


def weights(pool: DataFrame, alpha: float = 0.25, temperature: float = 1.0) -> DataFrame:
    """pool with n, its size, and p: alpha parts of the softmax of score / temperature, the rest of the uniform share (W5). A
    pool with a score that is missing or not finite is uniform. Sizes and sums come from aggregates that are joined back,
    so that a pool of very many candidates is no single window."""
    fine = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    size = pool.groupBy("pool_id").agg(F.count("*").alias("n"), F.max("score").alias("top"), F.bool_and(fine).alias("fine"))
    x = pool.join(size, "pool_id").withColumn("soft", F.when(F.col("fine"), F.exp((F.col("score") - F.col("top")) / temperature)).otherwise(1.0))
    total = x.groupBy("pool_id").agg(F.sum("soft").alias("z"))
    return x.join(total, "pool_id").withColumn("p", alpha * F.col("soft") / F.col("z") + (1 - alpha) / F.col("n")).drop("top", "soft", "z", "fine")


def pool_signals(pool: DataFrame, values: DataFrame, alpha: float = 0.25) -> DataFrame:
    """Per pool and attribute: expected remaining candidates, shrink, resolve@10 and coverage.

    pool: pool_id, id, score; values: id, attribute, value (one a product). A candidate stays compatible with a target if
    either lacks the attribute or both have the same value, so what remains for a target is the missing plus its own
    value's group: counts by value, never pairs of candidates."""
    x = weights(pool, alpha)
    hit = x.join(values, "id").groupBy("pool_id", "n", "attribute", "value").agg(F.count("*").alias("c"), F.sum("p").alias("p"))
    known = Window.partitionBy("pool_id", "attribute")
    hit = hit.withColumn("covered", F.sum("c").over(known)).withColumn("rem", F.col("n") - F.col("covered") + F.col("c"))
    out = hit.groupBy("pool_id", "attribute", "n").agg(F.sum("p").alias("coverage"), F.sum(F.col("p") * F.col("rem")).alias("known_rem"), F.sum(F.when(F.col("rem") <= 10, F.col("p")).otherwise(0.0)).alias("r10"))
    rest = 1 - F.col("coverage")  # targets without the attribute leave all candidates
    expected = F.col("known_rem") + rest * F.col("n")
    r10 = F.col("r10") + F.when(F.col("n") <= 10, rest).otherwise(0.0)
    clamp = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    return out.select("pool_id", "attribute", F.round(expected, 4).alias("expected"), F.round(clamp(1 - expected / F.col("n")), 6).alias("shrink"), F.round(clamp(r10), 6).alias("resolve10"), F.round(clamp(F.col("coverage")), 6).alias("coverage"))


def candidate_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question value of each attribute for the pool of each product type."""
    c = catalog(spark, sf_dir)
    pool = c.select(F.lower("category").alias("pool_id"), F.col("asin").alias("id"), F.log1p(F.col("rating_number").cast("double")).alias("score"))
    values = attribute_values(c).select(F.col("asin").alias("id"), "attribute", "value")
    return pool_signals(pool, values)


CANDIDATE_SIGNALS_SQL = f"""WITH {CATALOG_SQL}, {_VALUES_SQL},
x AS (SELECT lower(category) AS pool_id, asin, ln(1 + rating_number) AS s, count(*) OVER (PARTITION BY lower(category)) AS n FROM catalog),
y AS (SELECT *, exp(s - max(s) OVER (PARTITION BY pool_id)) AS e FROM x), z AS (SELECT *, 0.25 * e / sum(e) OVER (PARTITION BY pool_id) + 0.75 / n AS p FROM y),
j AS (SELECT a.pool_id, t.attribute, a.n, a.p, v.value, CASE WHEN v.value IS NULL THEN a.n ELSE a.n - count(v.value) OVER (PARTITION BY a.pool_id, t.attribute) + count(*) OVER (PARTITION BY a.pool_id, t.attribute, v.value) END AS rem
      FROM z a CROSS JOIN (SELECT DISTINCT attribute FROM val) t LEFT JOIN val v ON v.asin = a.asin AND v.attribute = t.attribute)
SELECT pool_id, attribute, round(sum(p * rem), 4) AS expected, round(greatest(0, least(1, 1 - sum(p * rem) / any_value(n))), 6) AS shrink, round(greatest(0, least(1, sum(CASE WHEN rem <= 10 THEN p ELSE 0 END))), 6) AS resolve10,
  round(least(1, sum(CASE WHEN value IS NOT NULL THEN p ELSE 0 END)), 6) AS coverage FROM j GROUP BY pool_id, attribute"""

QUERIES = {f.__name__: f for f in (category_signals, budget_buckets, candidate_signals)}
SQL = dict(zip(QUERIES, (CATEGORY_SIGNALS_SQL, BUDGET_SQL, CANDIDATE_SIGNALS_SQL), strict=True))
