"""Balanced folds of groups, population bins, and digests that say where two tables differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.sources.staging import stored
from quern.sources.views import read

FOLDS, SEED = 5, 7
#: Candidates up to which a population is small, and medium.
SMALL, MEDIUM = 10, 100
#: Hex digits of the name of a range of keys, and of a range of ranges.
LEAF, NODE = 3, 1


def _hash(c: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{SEED}:"), c.cast("string")))


def global_rank(rows: DataFrame, first: list[Column], name: Column) -> DataFrame:
    """rows with place, from 0, by the columns of first and then by the hash of name, without one task that sorts all: counts
    of (first, leading hash digits) are summed up to where each of them begins, and rows are numbered within."""
    keyed = stored(rows.withColumns({**{f"_f{i}": c for i, c in enumerate(first)}, "_h": _hash(name)}).withColumn("_b", F.substring("_h", 1, 3)), "keyed")
    by = [f"_f{i}" for i in range(len(first))]
    counts = keyed.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    coarse = counts.groupBy(*by).agg(F.sum("_n").alias("_m"))  # a row for each distinct value of first
    starts = coarse.withColumn("_start", F.sum("_m").over(Window.orderBy(*by)) - F.col("_m")).drop("_m")
    inner = counts.withColumn("_in", F.sum("_n").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_n")).drop("_n")
    within = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", name)) - 1
    x = keyed.withColumn("_within", within).join(inner, [*by, "_b"]).join(starts, by)
    return x.withColumn("place", F.col("_start") + F.col("_in") + F.col("_within")).drop(*by, "_h", "_b", "_within", "_in", "_start")


def deal_groups(samples: DataFrame, folds: int = FOLDS) -> DataFrame:
    """target, n, fold: whole groups of samples (target, stratum), the largest first, dealt to and fro over the folds.

    Two folds differ by the largest group at most, and groups of a size are dealt by their first stratum, so that strata
    spread too. No target is in two folds."""
    groups = samples.groupBy("target").agg(F.count("*").alias("n"), F.min("stratum").alias("stratum"))
    ranked = global_rank(groups, [-F.col("n"), F.coalesce("stratum", F.lit(""))], F.col("target"))
    turn = F.pmod("place", F.lit(2 * folds))
    return ranked.select("target", "n", F.when(turn < folds, turn).otherwise(2 * folds - 1 - turn).cast("int").alias("fold"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, target, stratum: the product of an order's last line, and the order's priority."""
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    last = lines.groupBy(F.col("l_orderkey").alias("session_id")).agg(F.max_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("target"))
    return last.join(orders.select(F.col("o_orderkey").alias("session_id"), F.col("o_orderpriority").alias("stratum")), "session_id")


def balanced_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of each target product with its number of sessions."""
    return deal_groups(targets(spark, sf_dir))


_TARGETS = "tg AS (SELECT session_id, target, o_orderpriority AS stratum FROM (SELECT l_orderkey AS session_id, arg_max(l_partkey, (l_linenumber, l_partkey)) AS target FROM lineitem GROUP BY 1) JOIN orders ON o_orderkey = session_id)"
FOLDS_SQL = f"""WITH {_TARGETS}, g AS (SELECT target, count(*) AS n, min(stratum) AS stratum FROM tg GROUP BY 1),
r AS (SELECT *, (row_number() OVER (ORDER BY n DESC, coalesce(stratum, ''), md5('{SEED}:' || target), target) - 1) % {2 * FOLDS} AS turn FROM g)
SELECT target, n, (CASE WHEN turn < {FOLDS} THEN turn ELSE {2 * FOLDS - 1} - turn END)::INT AS fold FROM r"""


def population_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By fold: sessions whose target has a small, medium or large population of candidates, those of its type and store."""
    part = read(spark, sf_dir, "part")
    size = part.groupBy("p_type", "p_brand").agg(F.count("*").alias("population"))
    own = part.join(size, ["p_type", "p_brand"]).select(F.col("p_partkey").alias("target"), "population")
    fold = balanced_folds(spark, sf_dir).select("target", "fold")
    name = F.when(F.col("population") <= SMALL, "small").when(F.col("population") <= MEDIUM, "medium").otherwise("large")
    return targets(spark, sf_dir).join(own, "target").join(fold, "target").groupBy("fold", name.alias("bin")).agg(F.count("*").alias("n"), F.count_distinct("target").alias("n_targets"))


BINS_SQL = f"""WITH fd AS ({FOLDS_SQL}), {_TARGETS}, pp AS (SELECT p_partkey AS target, count(*) OVER (PARTITION BY p_type, p_brand) AS population FROM part)
SELECT fold, CASE WHEN population <= {SMALL} THEN 'small' WHEN population <= {MEDIUM} THEN 'medium' ELSE 'large' END AS bin, count(*) AS n, count(DISTINCT tg.target) AS n_targets FROM tg JOIN pp USING (target) JOIN fd USING (target) GROUP BY ALL"""


def _xor_columns(digest: Column) -> list[Column]:
    """bit_xor aggregates of a 256-bit digest in hex, 13 digits at a time."""
    return [F.bit_xor(F.conv(F.substring(digest, 13 * i + 1, 13), 16, 10).cast("bigint")).alias(f"x{i}") for i in range(5)]


def key_digests(table: DataFrame, key: str) -> DataFrame:
    """level, range, n, digest of a tree over the ranges of a table's keys (S7): leaves are ranges of hashed keys, a node's digest
    is over its children's, and the root's over all. A leaf folds the 256-bit digests of its rows by exclusive or, so the order of
    rows doesn't matter; the number of rows stands beside it, as equal rows in pairs cancel."""
    row = F.sha2(F.to_json(F.struct(*sorted(table.columns)), {"ignoreNullFields": "false"}), 256)
    leaf = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, LEAF)
    sums = table.select(leaf.alias("range"), row.alias("d")).groupBy("range").agg(F.count("*").alias("n"), *_xor_columns(F.col("d")))
    leaves = sums.select(F.lit(LEAF).alias("level"), "range", "n", F.sha2(F.concat_ws(":", "n", *[f"x{i}" for i in range(5)]), 256).alias("digest"))

    def above(below: DataFrame, level: int) -> DataFrame:
        by = F.substring("range", 1, level)
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "digest"))), lambda x: F.concat(x["range"], F.lit("="), x["digest"])), ",")  # 256 children at most
        return below.groupBy(by.alias("range")).agg(F.sum("n").alias("n"), F.sha2(joined, 256).alias("digest")).select(F.lit(level).alias("level"), "range", "n", "digest")

    leaves = stored(leaves, "leaves")
    nodes = above(leaves, NODE)
    return leaves.unionByName(nodes).unionByName(above(nodes, 0))


def changed_ranges(own: DataFrame, expected: DataFrame) -> DataFrame:
    """level, range, n, n_expected of all nodes whose digest isn't the expected one, missing and new ones among them."""
    a, b = own.select("level", "range", "n", F.col("digest").alias("d")), expected.select("level", "range", F.col("n").alias("n_expected"), F.col("digest").alias("e"))
    x = a.join(b, ["level", "range"], "full")
    return x.filter(~F.col("d").eqNullSafe(F.col("e"))).select("level", "range", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_expected", F.lit(0)).alias("n_expected"))


def table_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the order lines differ from what the expected digests say: lines of two products stand for a changed table, as their
    returns are taken back. Named are the changed ranges of orders at every level, found without a compare of rows (S7)."""
    names = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    own = read(spark, sf_dir, "lineitem").select(*names)
    changed = own.withColumn("l_returnflag", F.when(F.col("l_partkey").isin(1, 2), "N").otherwise(F.col("l_returnflag")))
    return changed_ranges(key_digests(changed, "l_orderkey"), key_digests(own, "l_orderkey"))


DIFFERENCES_SQL = f"""WITH r AS (SELECT md5(l_orderkey::VARCHAR) AS h, l_partkey IN (1, 2) AND l_returnflag <> 'N' AS changed FROM lineitem),
l AS (SELECT level, substr(h, 1, level) AS range, changed FROM r, (SELECT unnest([0, {NODE}, {LEAF}]) AS level))
SELECT level::INT AS level, range, count(*) AS n, count(*) AS n_expected FROM l GROUP BY ALL HAVING bool_or(changed)"""

QUERIES = {f.__name__: f for f in (balanced_folds, population_bins, table_differences)}
SQL = dict(zip(QUERIES, (FOLDS_SQL, BINS_SQL, DIFFERENCES_SQL), strict=True))
