"""Catalogue profiling: coverage, dirty counters, quantiles, histograms, vocabulary counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.sources.views import CATALOG_SQL, catalog, read


def catalog_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field coverage and dirty counters in one pass."""
    c = catalog(spark, sf_dir)
    share = lambda cond: F.round(F.avg(F.when(cond, 1.0).otherwise(0.0)), 6)
    return c.agg(
        F.count("*").alias("n_products"), (F.count("asin") - F.count_distinct("asin")).alias("n_duplicate_ids"), share(F.col("title").isNotNull()).alias("title_coverage"),
        share(F.col("price").isNotNull()).alias("price_coverage"), share(F.col("rating_number") > 0).alias("rating_coverage"), F.count_if(F.length("title") < 10).alias("n_short_titles"),
        F.count_if(F.col("price") <= 0).alias("n_bad_prices"), F.count_if(F.col("title").rlike(r"[\x00-\x1f]")).alias("n_control_chars"), F.count_if(F.lower("store").isin("unknown", "n/a", "none", "")).alias("n_dirty_stores"),
    )


CATALOG_PROFILE_SQL = f"""WITH {CATALOG_SQL} SELECT count(*) AS n_products, count(asin) - count(DISTINCT asin) AS n_duplicate_ids, round(avg((title IS NOT NULL)::INT), 6) AS title_coverage,
  round(avg((price IS NOT NULL)::INT), 6) AS price_coverage, round(avg((rating_number > 0)::INT), 6) AS rating_coverage, count(*) FILTER (WHERE length(title) < 10) AS n_short_titles,
  count(*) FILTER (WHERE price <= 0) AS n_bad_prices, count(*) FILTER (WHERE regexp_matches(title, '[\\x00-\\x1f]')) AS n_control_chars, count(*) FILTER (WHERE lower(store) IN ('unknown', 'n/a', 'none', '')) AS n_dirty_stores FROM catalog"""

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def ranked_values(df: DataFrame, by: list[str], col: str, ranks: dict) -> DataFrame:
    """by, n, and the values of col at the given ranks (from 1; name to a function of n) of each group, nulls left out.

    Rows are counted by value first. The counts are range-partitioned by group and value, each range's total is added up
    over the ranges (one row a group and range), and running sums inside a range find the ranks: no group and no list of
    values is ever in one buffer, however many distinct values it has."""
    keys = [F.col(b) for b in by]
    counts = df.filter(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("_v")).agg(F.count("*").alias("_c"))
    parts = counts.repartitionByRange(*keys, F.col("_v")).withColumn("_part", F.spark_partition_id())
    totals = parts.groupBy(*by, "_part").agg(F.sum("_c").alias("_t"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = totals.select(*by, "_part", F.sum("_t").over(w).alias("n"), (F.sum("_t").over(w.orderBy("_part")) - F.col("_t")).alias("_b"))
    inside = parts.withColumn("_s", F.sum("_c").over(Window.partitionBy(*by, "_part").orderBy("_v"))).join(before, [*by, "_part"])
    low, high = F.col("_b") + F.col("_s") - F.col("_c"), F.col("_b") + F.col("_s")
    n = F.col("n")
    hits = [F.max(F.when((f(n) > low) & (f(n) <= high), F.col("_v"))).alias(name) for name, f in ranks.items()]
    return inside.groupBy(*by, "n").agg(*hits)


def floor_quantiles(df: DataFrame, col: str, quantiles=QUANTILES) -> DataFrame:
    """Value at the floor index n * p of the sorted column (A3)."""
    at = ranked_values(df, [], col, {f"q{i}": (lambda n, p=p: F.least(n, F.floor(n * p) + 1)) for i, p in enumerate(quantiles)})
    rows = F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"q{i}").alias("value")) for i, p in enumerate(quantiles)])
    return at.select(F.explode(rows).alias("q")).select("q.p", "q.value")


def price_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return floor_quantiles(catalog(spark, sf_dir), "price")


PRICE_QUANTILES_SQL = f"""WITH s AS (SELECT list(p_retailprice ORDER BY p_retailprice) AS v FROM part WHERE p_retailprice IS NOT NULL)
SELECT p::DOUBLE AS p, v[1 + floor(len(v) * p)::BIGINT] AS value FROM s, (SELECT unnest({list(QUANTILES)}) AS p)"""


def rating_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average-rating histogram by rating-count bucket (A5); the last rating bucket also takes values out of range."""
    c = catalog(spark, sf_dir).filter("average_rating is not null")
    r, n = F.col("average_rating"), F.col("rating_number")
    bucket = F.when((r >= 0) & (r < 1), "0-1").when((r >= 1) & (r < 2), "1-2").when((r >= 2) & (r < 3), "2-3").when((r >= 3) & (r < 4), "3-4").when((r >= 4) & (r < 5), "4-5").otherwise("5.0")
    size = F.when(n < 10, "<10").when(n < 50, "10-49").when(n < 100, "50-99").otherwise("100+")
    return c.groupBy(bucket.alias("rating"), size.alias("n_ratings")).agg(F.count("*").alias("n"))


RATING_BUCKETS_SQL = f"""WITH {CATALOG_SQL} SELECT CASE WHEN average_rating >= 0 AND average_rating < 1 THEN '0-1' WHEN average_rating >= 1 AND average_rating < 2 THEN '1-2' WHEN average_rating >= 2 AND average_rating < 3 THEN '2-3'
  WHEN average_rating >= 3 AND average_rating < 4 THEN '3-4' WHEN average_rating >= 4 AND average_rating < 5 THEN '4-5' ELSE '5.0' END AS rating,
  CASE WHEN rating_number < 10 THEN '<10' WHEN rating_number < 50 THEN '10-49' WHEN rating_number < 100 THEN '50-99' ELSE '100+' END AS n_ratings, count(*) AS n FROM catalog WHERE average_rating IS NOT NULL GROUP BY ALL"""


def top_categories(spark: SparkSession, sf_dir: str, n: int = 20) -> DataFrame:
    """Most frequent coarse categories and stores."""
    c = catalog(spark, sf_dir)
    both = c.select(F.explode(F.array(F.struct(F.lit("category").alias("kind"), T.coarse_category(F.col("categories")).alias("name")), F.struct(F.lit("store").alias("kind"), F.col("store").alias("name")))).alias("x"))
    return both.groupBy("x.kind", "x.name").agg(F.count("*").alias("n")).withColumn("slug", T.slug(F.col("name"))).orderBy(F.desc("n"), "kind", "name").limit(n)


TOP_CATEGORIES_SQL = f"""WITH {CATALOG_SQL}, b AS (SELECT 'category' AS kind, lower(category) AS name FROM catalog UNION ALL SELECT 'store', store FROM catalog)
SELECT kind, name, count(*) AS n, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM b GROUP BY kind, name ORDER BY n DESC, kind, name LIMIT 20"""

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
TOKENS_SQL = f"list_filter(regexp_extract_all(lower({{}}), '{T.TOKEN}'), lambda t: length(t) > 1 AND t NOT IN ({_STOP}))"


def term_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by term."""
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


TERM_DF_SQL = f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({TOKENS_SQL.format('text')})) AS term FROM documents) GROUP BY term"

#: Seed vocabulary: attribute, canonical, synonyms.
SEEDS = (("color", "red", ("red", "crimson")), ("color", "blue", ("blue", "navy")), ("size", "large", ("large", "big")), ("size", "small", ("small", "mini")), ("style", "old", ("old", "vintage")), ("style", "new", ("new", "modern")))


def seed_vocab_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products by canonical (largest count over its synonyms) and the synonyms seen, sorted."""
    terms = catalog(spark, sf_dir).select(F.explode(F.array_distinct(T.tokens(F.col("title")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    seeds = spark.createDataFrame([(a, c, t) for a, c, ts in SEEDS for t in ts], "attribute string, canonical string, synonym string")
    joined = F.broadcast(seeds).join(terms, F.col("synonym") == F.col("term"))
    return joined.groupBy("attribute", "canonical").agg(F.max("df").alias("n_products"), F.array_join(F.sort_array(F.collect_list("term")), ",").alias("seen"))


SEED_VOCAB_SQL = f"""WITH t AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({TOKENS_SQL.format('p_name')})) AS term FROM part) GROUP BY term),
s(attribute, canonical, term) AS (VALUES {", ".join(f"('{a}', '{c}', '{t}')" for a, c, ts in SEEDS for t in ts)})
SELECT attribute, canonical, max(df) AS n_products, array_to_string(list_sort(list(term)), ',') AS seen FROM s JOIN t USING (term) GROUP BY ALL"""


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions over all products."""
    c = catalog(spark, sf_dir)
    message = F.concat(F.lit("color: "), "title", F.lit(";  under $"), F.floor("price").cast("string"), F.lit(" ;"))
    return c.select(
        "asin", T.constraint_key(message).alias("key"), F.array_join(T.constraint_tokens(F.col("title")), " ").alias("words"), F.size(T.split_values(message)).alias("n_values"), T.classify_attribute(F.col("title")).alias("attribute"),
        T.price_of(message).alias("budget"), T.coarse_category(F.col("categories")).alias("shelf"), T.leaf_category(F.col("categories")).alias("leaf"), T.phrase_in(F.lower("title"), F.lower("category")).alias("names_category"),
        F.round(T.token_share(F.lower("title"), T.tokens(F.lit("red small part"))), 6).alias("share"),
    )


_CLASS_SQL = " ".join(f"WHEN regexp_matches(lower(title), '{p}') THEN '{n}'" for n, p in T.CLASSES)
TEXT_FUNCTIONS_SQL = rf"""WITH {CATALOG_SQL}, m AS (SELECT *, 'color: ' || title || ';  under $' || floor(price)::BIGINT || ' ;' AS msg, list_filter(['red', 'small', 'part'], lambda w: contains(lower(title), w)) AS hit FROM catalog)
SELECT asin, lower(trim(regexp_replace(trim(regexp_replace(msg, '(?i)^\s*(material|color|size|style|budget|feature)\s*:\s*', ''), ' -;,.' || chr(9) || chr(10)), '\s+', ' ', 'g'))) AS key,
  (SELECT array_to_string(list(w ORDER BY i), ' ') FROM (SELECT w, min(i) AS i FROM (SELECT unnest({TOKENS_SQL.format('title')}[1:6]) AS w, generate_subscripts({TOKENS_SQL.format('title')}[1:6], 1) AS i) GROUP BY w)) AS words,
  2 AS n_values, CASE {_CLASS_SQL} ELSE 'feature' END AS attribute, floor(price)::DOUBLE AS budget, lower(category) AS shelf, category AS leaf,
  length(category) BETWEEN 3 AND 180 AND contains(lower(title), lower(category)) AS names_category, round(len(hit) / 3, 6) AS share FROM m"""

QUERIES = {f.__name__: f for f in (catalog_profile, price_quantiles, rating_buckets, top_categories, term_document_frequency, seed_vocab_counts, text_functions)}
SQL = dict(zip(QUERIES, (CATALOG_PROFILE_SQL, PRICE_QUANTILES_SQL, RATING_BUCKETS_SQL, TOP_CATEGORIES_SQL, TERM_DF_SQL, SEED_VOCAB_SQL, TEXT_FUNCTIONS_SQL), strict=True))
