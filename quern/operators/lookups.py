"""Lookups in vocabularies and tables of settings, vocabulary merging, table digests, keyed product reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.profile import SEEDS, TOKENS_SQL
from quern.sources.views import CATALOG_SQL, catalog, read

#: Expansions of one word, beside its canonical.
MAX_EXPANSIONS = 6


def vocabulary(spark: SparkSession) -> DataFrame:
    """The seed vocabulary, one row a term: attribute, canonical, term, pos. It is a few lines of settings."""
    rows = [(a, c, t, i) for i, (a, c, t) in enumerate((a, c, t) for a, c, ts in SEEDS for t in ts)]
    return spark.createDataFrame(rows, "attribute string, canonical string, term string, pos int")


VOCABULARY_SQL = f"""vocab(attribute, canonical, term, pos) AS (VALUES {", ".join(f"('{a}', '{c}', '{t}', {i})" for i, (a, c, t) in enumerate((a, c, t) for a, c, ts in SEEDS for t in ts))})"""


def expansions(vocab: DataFrame) -> DataFrame:
    """word, attribute, canonical, expansion: for each term the other terms of its canonical, in their order."""
    own, other = vocab.alias("o"), vocab.alias("x")
    same = (F.col("o.attribute") == F.col("x.attribute")) & (F.col("o.canonical") == F.col("x.canonical")) & (F.col("o.term") != F.col("x.term"))
    found = F.slice(F.transform(F.sort_array(F.collect_list(F.struct("x.pos", "x.term"))), lambda s: s["term"]), 1, MAX_EXPANSIONS)
    return own.join(other, same).groupBy(F.col("o.term").alias("word"), "o.attribute", "o.canonical").agg(found.alias("expansion"))


def synonym_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical and synonyms of each title word that the vocabulary knows."""
    words = catalog(spark, sf_dir).select("asin", F.explode(F.array_distinct(T.tokens(F.col("title")))).alias("word"))
    return words.join(expansions(vocabulary(spark)), "word").select("asin", "word", "attribute", "canonical", F.array_join("expansion", ",").alias("expansion"))


EXPANSION_SQL = f"""WITH {VOCABULARY_SQL}, w AS (SELECT DISTINCT p_partkey AS asin, unnest({TOKENS_SQL.format("p_name")}) AS word FROM part),
r AS (SELECT o.term AS word, o.attribute, o.canonical, x.term, row_number() OVER (PARTITION BY o.term, o.attribute, o.canonical ORDER BY x.pos) AS n, x.pos FROM vocab o JOIN vocab x ON o.attribute = x.attribute AND o.canonical = x.canonical AND o.term <> x.term),
e AS (SELECT word, attribute, canonical, string_agg(term, ',' ORDER BY pos) AS expansion FROM r WHERE n <= {MAX_EXPANSIONS} GROUP BY ALL)
SELECT asin, word, attribute, canonical, expansion FROM w JOIN e USING (word)"""


def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to add to each document's query text: synonyms of its words that it doesn't hold yet, sorted (J7). Every
    document is a row of the result. The vocabulary is a literal map, so no row is exploded or shuffled."""
    pairs: dict[str, list[str]] = {}
    for _, _, terms in SEEDS:
        for t in terms:
            pairs.setdefault(t, []).extend(x for x in terms if x != t)
    known = F.create_map(*[c for t, xs in pairs.items() for c in (F.lit(t), F.array(*map(F.lit, xs)))])
    words = F.coalesce(F.array_distinct(T.tokens(F.col("text"))), F.array().cast("array<string>"))
    hits = F.flatten(F.transform(F.filter(words, lambda w: F.map_contains_key(known, w)), lambda w: F.element_at(known, w)))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(F.array_except(hits, words)), ",").alias("added"))


QUERY_EXPANSION_SQL = f"""WITH {VOCABULARY_SQL}, w AS (SELECT DISTINCT doc_id, unnest({TOKENS_SQL.format("text")}) AS word FROM documents WHERE text IS NOT NULL),
a AS (SELECT DISTINCT doc_id, x.term FROM w JOIN vocab o ON o.term = w.word JOIN vocab x ON x.attribute = o.attribute AND x.canonical = o.canonical AND x.term <> o.term),
b AS (SELECT doc_id, string_agg(term, ',' ORDER BY term) AS added FROM a WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.doc_id = a.doc_id AND w.word = a.term) GROUP BY doc_id)
SELECT doc_id, coalesce(added, '') AS added FROM documents LEFT JOIN b USING (doc_id)"""


def owner_conflicts(vocab: DataFrame) -> DataFrame:
    """The first canonical (by pos) owns a term; each later one is a conflict: canonical, term, owner. The owner is
    aggregated first, so that a term of very many canonicals doesn't fill one window."""
    first = vocab.groupBy("term", "canonical").agg(F.min("pos").alias("pos"))
    owner = first.groupBy("term").agg(F.min_by("canonical", F.struct("pos", "canonical")).alias("owner"))
    return first.join(owner, "term").filter("canonical <> owner").select("canonical", "term", "owner")


def term_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title words that several stores use, held against the store that used them first."""
    return owner_conflicts(catalog(spark, sf_dir).select(F.col("store").alias("canonical"), F.explode(T.tokens(F.col("title"))).alias("term"), F.col("asin").alias("pos")))


CONFLICTS_SQL = f"""WITH f AS (SELECT canonical, term, min(pos) AS pos FROM (SELECT p_brand AS canonical, unnest({TOKENS_SQL.format("p_name")}) AS term, p_partkey AS pos FROM part) GROUP BY ALL),
o AS (SELECT term, arg_min(canonical, pos) AS owner FROM f GROUP BY term) SELECT canonical, term, owner FROM f JOIN o USING (term) WHERE canonical <> owner"""


def merge_outcome(owner: Column, canonical_known: Column, canonical: Column, share: Column, least: float) -> Column:
    """What merging a candidate synonym comes to; conflicts are reported and never overwrite the owner."""
    return (
        F.when(~canonical_known, "missing_canonical").when(owner == canonical, "present").when(owner.isNotNull(), "conflict")
        .when(share < least, "no_evidence").otherwise("new")
    )


def vocabulary_merge(spark: SparkSession, sf_dir: str, least: float = 0.125) -> DataFrame:
    """Outcome of each candidate (first title word as canonical, any title word as term) against the seeds (V8, V9)."""
    words = T.tokens(F.col("title"))
    titles = catalog(spark, sf_dir).select(words.alias("w")).filter(F.size("w") > 0)
    pairs = titles.select(F.col("w")[0].alias("canonical"), F.explode(F.array_distinct("w")).alias("term")).groupBy("canonical", "term").agg(F.count("*").alias("n"))
    total = titles.groupBy(F.col("w")[0].alias("canonical")).agg(F.count("*").alias("total"))
    vocab = vocabulary(spark)
    owners = vocab.groupBy("term").agg(F.min_by("canonical", "pos").alias("owner"))
    known = vocab.select("canonical").distinct().withColumn("known", F.lit(True))
    joined = pairs.join(total, "canonical").join(owners, "term", "left").join(known, "canonical", "left")
    outcome = merge_outcome(F.col("owner"), F.coalesce("known", F.lit(False)), F.col("canonical"), F.col("n") / F.col("total"), least)
    return joined.select("canonical", "term", "n", outcome.alias("outcome"))


MERGE_SQL = f"""WITH {VOCABULARY_SQL}, t AS (SELECT {TOKENS_SQL.format("p_name")} AS w FROM part), s AS (SELECT w FROM t WHERE len(w) > 0),
p AS (SELECT canonical, term, count(*) AS n FROM (SELECT w[1] AS canonical, unnest(list_distinct(w)) AS term FROM s) GROUP BY ALL), c AS (SELECT w[1] AS canonical, count(*) AS total FROM s GROUP BY 1),
o AS (SELECT term, arg_min(canonical, pos) AS owner FROM vocab GROUP BY term)
SELECT canonical, term, n, CASE WHEN canonical NOT IN (SELECT canonical FROM vocab) THEN 'missing_canonical' WHEN owner = canonical THEN 'present' WHEN owner IS NOT NULL THEN 'conflict'
  WHEN n / total < 0.125 THEN 'no_evidence' ELSE 'new' END AS outcome FROM p JOIN c USING (canonical) LEFT JOIN o USING (term)"""


#: Rows that a table of limits may have: each choice is compared with every limit.
MAX_LIMITS = 1000


def best_within(limits: DataFrame, choices: DataFrame, keys: list[str]) -> DataFrame:
    """For each row of the short table of limits (max_price, max_size) the choice of the best score within both, ties to
    the smallest id (J14). Each task keeps one choice a limit; more than MAX_LIMITS limits are an error."""
    if limits.limit(MAX_LIMITS + 1).count() > MAX_LIMITS:
        raise ValueError(f"over {MAX_LIMITS} limits")
    fits = choices.join(F.broadcast(limits), (F.col("price") <= F.col("max_price")) & (F.col("size") <= F.col("max_size")))
    return fits.groupBy(*keys).agg(F.min_by("id", F.struct(-F.col("score"), "id")).alias("id"), F.max("score").alias("score"))


def best_within_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most-ordered product within each nation's limits of price and size."""
    n = F.col("n_nationkey")
    limits = read(spark, sf_dir, "nation").select("n_nationkey", (900 + 10 * n).alias("max_price"), (1 + 2 * n).alias("max_size"))
    c = catalog(spark, sf_dir).select(F.col("asin").alias("id"), F.col("rating_number").alias("score"), "price", "size")
    return best_within(limits, c, ["n_nationkey"])


BEST_SQL = f"""WITH {CATALOG_SQL}, r AS (SELECT n_nationkey, asin, rating_number, row_number() OVER (PARTITION BY n_nationkey ORDER BY rating_number DESC, asin) AS n
  FROM nation JOIN catalog ON price <= 900 + 10 * n_nationkey AND size <= 1 + 2 * n_nationkey) SELECT n_nationkey, asin AS id, rating_number AS score FROM r WHERE n = 1"""


def product_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary rows (last two categories) of the products that were returned."""
    ids = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("asin"))
    c = catalog(spark, sf_dir)
    last = F.when(F.size("categories") > 2, F.slice("categories", -2, 2)).otherwise(F.col("categories"))
    return c.join(ids, "asin", "left_semi").select("asin", "title", "store", F.array_join(last, " / ").alias("path"), "price")


SUMMARIES_SQL = f"WITH {CATALOG_SQL} SELECT asin, title, store, array_to_string(categories, ' / ') AS path, price FROM catalog WHERE asin IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')"


def digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """Digest of a table that its row order doesn't change: rows, sum and exclusive or of the rows' hashes."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])
    h = F.conv(F.substring(F.sha2(row, 256), 1, 8), 16, 10).cast("bigint")
    return df.agg(F.count("*").alias("n"), F.sum(h).alias("total"), F.bit_xor(h).alias("mixed"))


def catalog_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "part"), ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])


DIGEST_SQL = r"""WITH h AS (SELECT ('0x' || substr(sha256(concat_ws('|', p_partkey::VARCHAR, coalesce(p_name, '\N'), coalesce(p_brand, '\N'), coalesce(p_type, '\N'), coalesce(p_size::VARCHAR, '\N'))), 1, 8))::BIGINT AS h FROM part)
SELECT count(*) AS n, sum(h)::BIGINT AS total, bit_xor(h) AS mixed FROM h"""


def first_examples(spark: SparkSession, sf_dir: str, n: int = 20) -> DataFrame:
    """The first n orders of each customer segment by day and key (W7). Each partition keeps n a segment before the shuffle
    (Spark pushes the rank limit below it)."""
    orders, who = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    rank = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("o_orderdate", "o_orderkey"))
    joined = orders.join(who, orders["o_custkey"] == who["c_custkey"])
    return joined.select("c_mktsegment", "o_orderkey", rank.alias("pos")).filter(F.col("pos") <= n)


EXAMPLES_SQL = """SELECT c_mktsegment, o_orderkey, pos FROM (SELECT c_mktsegment, o_orderkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_orderdate, o_orderkey) AS pos
  FROM orders JOIN customer ON o_custkey = c_custkey) WHERE pos <= 20"""

QUERIES = {f.__name__: f for f in (synonym_expansion, query_expansion, term_conflicts, vocabulary_merge, best_within_limits, product_summaries, catalog_digest, first_examples)}
SQL = dict(zip(QUERIES, (EXPANSION_SQL, QUERY_EXPANSION_SQL, CONFLICTS_SQL, MERGE_SQL, BEST_SQL, SUMMARIES_SQL, DIGEST_SQL, EXAMPLES_SQL), strict=True))
