"""Retrieval routes, fusion and ranking over all queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.profile import TOKENS_SQL
from quern.sources.staging import stored
from quern.sources.views import CATALOG_SQL, catalog, read

#: Okapi constants, and field weights.
K1, B = 1.5, 0.75
FIELDS = {"title": 6.0, "body": 1.0}
TOP_K, RRF_K = 10, 60


def postings(docs: DataFrame, id_col: str, fields: dict[str, Column], terms: DataFrame) -> DataFrame:
    """id, field, term, tf, dl: the postings of the given terms, stored, and one row with the empty term for each document and
    field, from which counts and mean lengths follow. Texts are tokenised in this one pass, whatever reads the postings."""
    parts = F.array(*[F.struct(F.lit(n).alias("field"), T.tokens(c).alias("t")) for n, c in fields.items()])
    long = docs.select(F.col(id_col).alias("id"), F.explode(parts).alias("x")).select("id", "x.field", F.size("x.t").alias("dl"), F.explode(F.concat("x.t", F.array(F.lit("")))).alias("term"))
    wanted = terms.select("term").distinct().union(docs.sparkSession.createDataFrame([("",)], "term string"))
    return stored(long.join(wanted, "term", "left_semi").groupBy("id", "field", "term", "dl").agg(F.count("*").alias("tf")), "postings")


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term: the distinct tokens of each query."""
    return queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("term"))


def bm25(index: DataFrame, terms: DataFrame, weights: dict[str, float]) -> DataFrame:
    """query_id, id, score: weighted Okapi over fields; each distinct query term counts once."""
    sizes = index.filter("term = ''").groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    wanted = index.filter("term <> ''")
    # stored, so that its size is known: a small one goes to the postings, which then aren't shuffled by terms
    df = stored(wanted.groupBy("field", "term").agg(F.count("*").alias("df")), "document-frequencies")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("field")]
    tf = F.col("tf").cast("double")
    part = weight * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = wanted.join(df, ["field", "term"]).join(F.broadcast(sizes), "field").select("term", "id", part.alias("part"))  # sizes: a row a field
    return scored.join(terms, "term").groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("score"))


def top_k(scored: DataFrame, k: int, partition: str = "query_id", order: tuple = ("-score", "id")) -> DataFrame:
    """rank from 1 by order ('-' first: descending), rows up to k (W1, W2). Spark limits each group before the shuffle."""
    by = [F.desc(o[1:]) if o[0] == "-" else F.asc(o) for o in order]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(partition).orderBy(*by))).filter(F.col("rank") <= k)


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored postings of the benchmark passages' terms, and those terms."""
    docs = read(spark, sf_dir, "documents").filter("text is not null")
    terms = query_terms(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))
    return postings(docs, "doc_id", {"title": F.substring_index("text", ".", 1), "body": F.col("text")}, terms), terms


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25(*_index(spark, sf_dir), FIELDS)


def bm25_okapi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best documents of every benchmark passage by weighted Okapi BM25."""
    return top_k(_bm25(spark, sf_dir), TOP_K).select("query_id", "id", "score", "rank")


_BM25_CTES = f"""q AS (SELECT item_id AS query_id, unnest(list_distinct({TOKENS_SQL.format('text')})) AS term FROM benchmark),
f AS (SELECT doc_id AS id, 'title' AS field, 6.0::DOUBLE AS w, {TOKENS_SQL.format("split_part(text, '.', 1)")} AS t FROM documents WHERE text IS NOT NULL
      UNION ALL SELECT doc_id, 'body', 1.0::DOUBLE, {TOKENS_SQL.format('text')} FROM documents WHERE text IS NOT NULL),
a AS (SELECT field, avg(len(t)) AS avgdl, count(*) AS n FROM f GROUP BY field),
p AS (SELECT id, field, w, dl, term, count(*)::DOUBLE AS tf FROM (SELECT id, field, w, len(t) AS dl, unnest(t) AS term FROM f) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
d AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL),
bm AS (SELECT query_id, id, round(sum(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * dl / avgdl))), 6) AS score
      FROM p JOIN d USING (field, term) JOIN a USING (field) JOIN q USING (term) GROUP BY ALL)"""
BM25_SQL = f"WITH {_BM25_CTES} SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm) WHERE rank <= {TOP_K}"


def verbatim(docs: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, id: documents (doc_id, text) that hold a passage (item_id, text) as a substring.

    A passage of three words or more has inner words that the document has as words too: the rarest of them gives the
    candidates. Shorter ones may lie inside words, so their first characters, up to three, are looked for among the
    documents' character sequences of that length, which is done only where there are such passages."""
    docs, items = docs.filter("text is not null"), items.filter("length(text) > 0")
    words = lambda c: F.filter(F.split(c, " "), lambda w: F.length(w) > 0)
    named = items.select("item_id", F.col("text").alias("passage"), words(F.col("text")).alias("ws"))
    texts = docs.select(F.col("doc_id").alias("_d"), "text")
    inner = named.filter("size(ws) > 2").select("item_id", "passage", F.explode(F.array_distinct(F.slice("ws", 2, F.size("ws") - 2))).alias("w"))
    in_docs = docs.select("doc_id", F.explode(F.array_distinct(words(F.col("text")))).alias("w")).join(inner.select("w").distinct(), "w", "left_semi")
    in_docs = stored(in_docs, "words")
    rarest = inner.join(in_docs.groupBy("w").agg(F.count("*").alias("df")), "w").groupBy("item_id", "passage").agg(F.min_by("w", F.struct("df", "w")).alias("w"))
    pairs = in_docs.join(rarest, "w").select("item_id", "passage", "doc_id")
    few = named.filter("size(ws) <= 2").select("item_id", "passage", F.substring("passage", 1, 3).alias("w"))
    if not few.isEmpty():
        for n in (1, 2, 3):
            cut = F.transform(F.sequence(F.lit(1), F.length("text") - n + 1), lambda i: F.substring(F.col("text"), i, F.lit(n)))  # noqa: B023
            grams = docs.filter(F.length("text") >= n).select("doc_id", F.explode(F.array_distinct(cut)).alias("w"))
            pairs = pairs.union(grams.join(few.filter(F.length("w") == n), "w").select("item_id", "passage", "doc_id"))
    both = pairs.join(texts, F.col("doc_id") == F.col("_d"))
    return both.filter(F.contains("text", F.col("passage"))).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("id")).distinct()


def _relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verbatim(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rate and mean reciprocal rank at TOP_K of BM25 on the passages found verbatim in documents (flagship; W10, A22)."""
    ranked = top_k(_bm25(spark, sf_dir), TOP_K)
    relevant = stored(_relevance(spark, sf_dir), "relevant")
    hits = ranked.join(relevant, ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("best"))
    judged = relevant.select("query_id").distinct().join(hits, "query_id", "left")
    return judged.agg(F.count("*").alias("n_queries"), F.round(F.avg(F.when(F.col("best").isNotNull(), 1.0).otherwise(0.0)), 6).alias("hit_rate"), F.round(F.avg(F.coalesce(1 / F.col("best"), F.lit(0.0))), 6).alias("mrr"))


METRICS_SQL = f"""WITH {_BM25_CTES}, rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm),
rel AS (SELECT DISTINCT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) > 0),
h AS (SELECT query_id, min(rank) AS best FROM rk JOIN rel USING (query_id, id) WHERE rank <= {TOP_K} GROUP BY 1)
SELECT count(*) AS n_queries, round(avg((best IS NOT NULL)::INT), 6) AS hit_rate, round(avg(coalesce(1.0 / best, 0)), 6) AS mrr FROM (SELECT DISTINCT query_id FROM rel) LEFT JOIN h USING (query_id)"""

def category_shares(wanted: DataFrame, categories: DataFrame) -> DataFrame:
    """query_id, cat, share of the wanted words (query_id, words) that occur in the category as substrings, over half of them
    (F1). Words of two letters or more meet categories by their first two letters, so only such pairs are compared."""
    pairs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))
    by_two = categories.select("cat", F.explode(pairs(F.col("cat"))).alias("g"))
    met = wanted.select("query_id", "words", F.explode("words").alias("w")).withColumn("g", F.substring("w", 1, 2)).join(by_two, "g").select("query_id", "words", "cat").distinct()
    return met.withColumn("share", T.token_share(F.col("cat"), F.col("words"))).filter(F.col("share") > 0.5).select("query_id", "cat", "share")


def category_route(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """Products by share of the wanted type's tokens in their category plus 0.01 ln(1 + ratings) (R4, F1, W2); one query a
    distinct type. Categories are matched first, products join by the whole category."""
    c = catalog(spark, sf_dir).select("asin", "rating_number", F.lower("category").alias("cat"))
    cats = c.select("cat").distinct()
    shares = category_shares(cats.select(F.col("cat").alias("query_id"), T.tokens(F.col("cat")).alias("words")), cats)
    scored = shares.join(c, "cat").withColumn("score", F.round(F.col("share") + 0.01 * F.log1p(F.col("rating_number").cast("double")), 6)).withColumnRenamed("asin", "id")
    return top_k(scored, k).select("query_id", "id", "score", "rank")


CATEGORY_ROUTE_SQL = f"""WITH {CATALOG_SQL}, w AS (SELECT DISTINCT lower(category) AS query_id, {TOKENS_SQL.format('category')} AS words FROM catalog),
s AS (SELECT query_id, asin AS id, len(list_filter(words, lambda x: contains(lower(category), x))) / len(words) AS share, rating_number FROM w, catalog),
r AS (SELECT query_id, id, round(share + 0.01 * ln(1 + rating_number), 6) AS score FROM s WHERE share > 0.5)
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r) WHERE rank <= 20"""


def reciprocal_rank_fusion(routes: dict[str, DataFrame], k: int = RRF_K, weights: dict[str, float] | None = None) -> DataFrame:
    """query_id, id, rrf, routes from ranked routes (U1, R9): one shuffle over the union."""
    every = None
    for name, df in routes.items():
        part = df.select("query_id", "id", F.lit(name).alias("route"), (F.lit((weights or {}).get(name, 1.0)) / (k + F.col("rank"))).alias("part"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("rrf"), F.array_join(F.sort_array(F.collect_set("route")), ",").alias("routes"))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion of the BM25 route and a term-overlap route over the benchmark passages."""
    index, terms = _index(spark, sf_dir)
    scored = bm25(index, terms, FIELDS)
    overlap = index.filter("field = 'title'").join(terms, "term").groupBy("query_id", "id").agg(F.count("*").alias("score"))
    fused = reciprocal_rank_fusion({"bm25": top_k(scored, 20), "title": top_k(overlap, 20)}, weights={"bm25": 1.0, "title": 0.8})
    ranked = top_k(fused.withColumnRenamed("rrf", "score"), TOP_K)
    w = Window.partitionBy("query_id")
    margin = F.coalesce(F.max(F.when(F.col("rank") == 1, F.col("score"))).over(w) - F.max(F.when(F.col("rank") == 2, F.col("score"))).over(w), F.lit(1.0))
    return ranked.select("query_id", "id", "score", "routes", "rank", F.round(F.col("score") / F.max("score").over(w), 6).alias("relative"), F.round(margin, 6).alias("margin"))


RRF_SQL = f"""WITH {_BM25_CTES}, b AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm),
o AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, id) AS rank FROM (SELECT query_id, id, count(*) AS n FROM p JOIN q USING (term) WHERE field = 'title' GROUP BY ALL)),
u AS (SELECT query_id, id, 'bm25' AS route, 1.0 / ({RRF_K} + rank) AS part FROM b WHERE rank <= 20 UNION ALL SELECT query_id, id, 'title', 0.8 / ({RRF_K} + rank) FROM o WHERE rank <= 20),
fu AS (SELECT query_id, id, round(sum(part::DOUBLE), 6) AS score, array_to_string(list_sort(list(route)), ',') AS routes FROM u GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fu)
SELECT query_id, id, score, routes, rank, round(score / max(score) OVER (PARTITION BY query_id), 6) AS relative,
  round(coalesce(max(CASE WHEN rank = 1 THEN score END) OVER (PARTITION BY query_id) - max(CASE WHEN rank = 2 THEN score END) OVER (PARTITION BY query_id), 1.0), 6) AS margin FROM r WHERE rank <= {TOP_K}"""


def rule_score(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """Constraint coverage, pair bonus, category match, popularity and the weighted rule score of the candidates of each
    wanted type for two fixed constraints, a colour word and a low price (R19); ranking.py has the real constraints."""
    c = catalog(spark, sf_dir).withColumn("query_id", F.lower("category"))
    text = F.lower(F.concat_ws(" ", "title", "category", "store"))
    hard, soft = F.contains(text, F.lit("red")).cast("double"), (F.col("price") <= 1200).cast("double")
    coverage = (hard + 0.4 * soft) / 1.4
    popularity = 0.5 * F.log1p(F.col("rating_number").cast("double")) / F.log(F.lit(10001.0)) + 0.5 * F.coalesce("average_rating", F.lit(0.0)) / 5
    both = ((hard == 1) & (soft == 1)).cast("double")
    score = 0.5 * coverage + 0.1 * both + 0.25 + 0.05 * popularity + (hard * 1.0) * (coverage >= 0.999).cast("double")
    scored = c.select("query_id", F.col("asin").alias("id"), F.round(coverage, 6).alias("coverage"), F.round(score, 6).alias("score"))
    return top_k(scored, k).select("query_id", "id", "coverage", "score", "rank")


RULE_SCORE_SQL = f"""WITH {CATALOG_SQL}, x AS (SELECT lower(category) AS query_id, asin AS id, contains(lower(concat_ws(' ', title, category, store)), 'red')::INT::DOUBLE AS h, (price <= 1200)::INT::DOUBLE AS s,
  0.5 * ln(1 + rating_number) / ln(10001) + 0.5 * coalesce(average_rating, 0) / 5 AS pop FROM catalog),
y AS (SELECT *, (h + 0.4 * s) / 1.4 AS c FROM x),
z AS (SELECT query_id, id, round(c, 6) AS coverage, round(0.5 * c + 0.1 * (h * s) + 0.25 + 0.05 * pop + h * (c >= 0.999)::INT, 6) AS score FROM y)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM z) WHERE rank <= 20"""


def fingerprint_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products by their whole set of title words, with the tier of the bonus."""
    c = catalog(spark, sf_dir).select("asin", F.explode(F.array_distinct(T.tokens(F.col("title")))).alias("key"))
    own = c.groupBy("asin").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    counts = own.groupBy(F.array_join("keys", " ").alias("combination")).agg(F.count("*").alias("n_products"))
    tier = F.when(F.col("n_products") == 1, 1.0).when(F.col("n_products") <= 10, 0.5).when(F.col("n_products") <= 50, 0.2).otherwise(0.0)
    return counts.withColumn("bonus", tier)


FINGERPRINT_SQL = f"""WITH t AS (SELECT p_partkey AS asin, list_sort(list_distinct({TOKENS_SQL.format('p_name')})) AS keys FROM part)
SELECT array_to_string(keys, ' ') AS combination, count(*) AS n_products, CASE WHEN count(*) = 1 THEN 1.0 WHEN count(*) <= 10 THEN 0.5 WHEN count(*) <= 50 THEN 0.2 ELSE 0.0 END::DOUBLE AS bonus FROM t WHERE len(keys) > 0 GROUP BY 1"""

def count_pairs(products: DataFrame) -> DataFrame:
    """Products that satisfy both constraints, for every pair of keys of a product (asin, keys: distinct and sorted)."""
    ys = lambda x, i: F.transform(F.slice("keys", i + 2, F.size("keys")), lambda y: F.struct(x.alias("first"), y.alias("second")))
    pairs = products.select("asin", F.explode(F.flatten(F.transform("keys", ys))).alias("k")).select("asin", "k.first", "k.second")
    counts = pairs.groupBy("first", "second").agg(F.count_distinct("asin").alias("n_products"))
    n = F.col("n_products")
    return counts.withColumn("bonus", F.when(n == 1, 1.0).when(n <= 10, 0.5).when(n <= 50, 0.2).otherwise(0.0))


def constraint_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that have both words, for every pair of title words, with the tier of the bonus."""
    c = catalog(spark, sf_dir).select("asin", F.array_sort(F.array_distinct(T.tokens(F.col("title")))).alias("keys"))
    return count_pairs(c)


PAIRS_SQL = f"""WITH t AS (SELECT p_partkey AS asin, unnest(list_distinct({TOKENS_SQL.format('p_name')})) AS key FROM part)
SELECT a.key AS first, b.key AS second, count(DISTINCT asin) AS n_products, CASE WHEN count(DISTINCT asin) = 1 THEN 1.0 WHEN count(DISTINCT asin) <= 10 THEN 0.5 WHEN count(DISTINCT asin) <= 50 THEN 0.2 ELSE 0.0 END::DOUBLE AS bonus
FROM t a JOIN t b USING (asin) WHERE a.key < b.key GROUP BY 1, 2"""

QUERIES = {f.__name__: f for f in (bm25_okapi_topk, retrieval_metrics, category_route, rrf_fusion, rule_score, fingerprint_count, constraint_pairs)}
SQL = dict(zip(QUERIES, (BM25_SQL, METRICS_SQL, CATEGORY_ROUTE_SQL, RRF_SQL, RULE_SCORE_SQL, FINGERPRINT_SQL, PAIRS_SQL), strict=True))
