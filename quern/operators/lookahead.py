"""What the best second question adds to a first one, and how stable the choice of a question is in smaller pools."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.questions import ATTRIBUTES, _pools, remaining, spread_signals
from quern.operators.signals import _VALUES_SQL, weights
from quern.sources.staging import stored
from quern.sources.views import CATALOG_SQL, catalog

#: Cost of a turn, candidates from which a second step is looked at, pool sizes, share of a deletion in percent.
TURN_COST, THRESHOLD, SIZES, DELETED = 0.1, 100, (300, 500, 1000), 10
SAMPLES, WHOLE = 20, "*"


def branch_signals(pool: DataFrame, wide: DataFrame, alpha: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """The measures of each second attribute in each branch that an answer to a first one leaves (Q4), and the weight of the
    branches (pool_id, first, branch, p).

    The branch of a value holds its candidates and those without one; a target without a value leaves the whole pool. Both
    levels come from one table of counts by (first value, second value): a branch is the row of its value plus the row of
    the missing, the whole is the margin, and weights are divided by the branch's. No two candidates meet."""
    key = lambda a: F.concat(F.lit("v:"), F.try_element_at("vals", F.lit(a)))
    asked = F.explode(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), key(a).alias("va"), key(b).alias("vb")) for a, b in permutations(ATTRIBUTES, 2)]))
    rows = weights(pool, alpha).join(wide, "id", "left").select("pool_id", "p", asked.alias("x")).select("pool_id", "p", "x.*")
    counts = stored(rows.groupBy("pool_id", "first", "second", "va", "vb").agg(F.count("*").alias("c"), F.sum("p").alias("p")), "value-pairs")
    by = ["pool_id", "first", "second"]
    targets = counts.groupBy(*by, "va").agg(F.sum("p").alias("p"))
    own = counts.filter("va is not null").withColumn("branch", F.col("va"))
    missing = counts.filter("va is null").drop("va").join(targets.filter("va is not null").select(*by, F.col("va").alias("branch")), by)
    whole = counts.join(targets.filter("va is null").select(*by, F.lit(WHOLE).alias("branch")), by)
    cells = own.drop("va").unionByName(missing).unionByName(whole.drop("va")).groupBy(*by, "branch", "vb").agg(F.sum("c").alias("c"), F.sum("p").alias("p"))
    sums = cells.groupBy(*by, "branch").agg(F.sum("c").alias("n"), F.sum("p").alias("mass"), F.sum(F.when(F.col("vb").isNull(), F.col("c")).otherwise(0)).alias("none"))
    x = cells.join(sums, [*by, "branch"]).filter("mass > 0")
    rem = F.when(F.col("vb").isNull(), F.col("n")).otherwise(F.col("c") + F.col("none"))
    spread = x.select(F.concat_ws("|", "pool_id", "first", "branch").alias("pool_id"), F.col("second").alias("asked"), "n", rem.alias("rem"), (F.col("p") / F.col("mass")).alias("p"), F.col("vb").isNotNull().alias("has"))
    spread = spread.groupBy("pool_id", "asked", "n", "rem").agg(F.sum("p").alias("p"), F.sum(F.when(F.col("has"), F.col("p")).otherwise(0.0)).alias("covered"))
    share = targets.filter(F.col("second") == F.when(F.col("first") == ATTRIBUTES[0], ATTRIBUTES[1]).otherwise(ATTRIBUTES[0]))
    return spread_signals(spread), share.select("pool_id", "first", F.coalesce("va", F.lit(WHOLE)).alias("branch"), "p")


def two_steps(pool: DataFrame, wide: DataFrame, alpha: float = 0.25) -> DataFrame:
    """pool_id, asked, two_step: the gain that the best second question is expected to bring after an answer, less a turn's cost,
    0 at least (Q4)."""
    signals, share = branch_signals(pool, wide, alpha)
    best = signals.groupBy("pool_id").agg(F.max("finish_gain").alias("best")).withColumnRenamed("pool_id", "key")
    gain = share.join(best, F.concat_ws("|", "pool_id", "first", "branch") == F.col("key")).groupBy("pool_id", "first").agg(F.sum(F.col("p") * F.col("best")).alias("g"))
    return gain.select("pool_id", F.col("first").alias("asked"), F.round(F.greatest(F.lit(0.0), F.col("g") - TURN_COST), 6).alias("two_step"))


def finish_gain_two_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-step and two-step finish gain of each attribute for the pool of each product type and store, and whether a second step
    would be looked at: a pool of THRESHOLD at most and a one-step gain over 0 (Q4, Q5)."""
    pool, wide = _pools(spark, sf_dir)
    store = catalog(spark, sf_dir).select(F.col("asin").alias("id"), "store")
    pool = pool.join(store, "id").select(F.concat_ws("/", "pool_id", "store").alias("pool_id"), "id", "score")
    one = spread_signals(remaining(pool, wide)).filter(~F.contains("asked", F.lit("+"))).select("pool_id", "asked", "finish_gain")
    size = pool.groupBy("pool_id").agg(F.count("*").alias("n"))
    best = one.groupBy("pool_id").agg(F.max("finish_gain").alias("most"))
    out = one.join(two_steps(pool, wide), ["pool_id", "asked"]).join(size, "pool_id").join(best, "pool_id")
    return out.select("pool_id", "asked", "n", F.col("finish_gain").alias("one_step"), "two_step", ((F.col("n") <= THRESHOLD) & (F.col("most") >= 0)).alias("looked_at"))


_WIDE = f"""wide AS (SELECT asin, {", ".join(f"max(CASE attribute WHEN '{a}' THEN value END) AS {a}_v" for a in ATTRIBUTES)} FROM val GROUP BY asin)"""
_OF = "CASE {} " + " ".join(f"WHEN '{a}' THEN {a}_v" for a in ATTRIBUTES) + " END"
_MEASURES = """sum(p * rem) AS expected, sum(CASE WHEN rem <= 10 THEN p ELSE 0 END) AS r10, sum(CASE WHEN rem <= 3 THEN p ELSE 0 END) AS r3, sum(CASE WHEN rem <= 1 THEN p ELSE 0 END) AS r1, min(rem) FILTER (WHERE cum >= 0.9) AS p90"""
_GAIN = "round(0.5 * r10 + 0.2 * r3 + 0.1 * r1 + 0.3 * CASE WHEN {0} <= 10 THEN 0 ELSE 1 - ln(1 + greatest(expected - 10, 0)) / ln(1 + {0} - 10) END - 0.2 * p90 / {0}, 6)"
#: Needs z (pool_id, asin, n, p) and wide.
_ONE = f"""a1 AS (SELECT pool_id, n, p, asked, {_OF.format("asked")} AS v FROM z LEFT JOIN wide USING (asin) CROSS JOIN (SELECT unnest({list(ATTRIBUTES)}) AS asked)),
b1 AS (SELECT *, CASE WHEN v IS NULL THEN n ELSE n - count(v) OVER (PARTITION BY pool_id, asked) + count(*) OVER (PARTITION BY pool_id, asked, v) END AS rem FROM a1),
c1 AS (SELECT *, round(sum(p) OVER (PARTITION BY pool_id, asked ORDER BY rem), 9) AS cum FROM (SELECT pool_id, asked, n, rem, sum(p) AS p FROM b1 GROUP BY ALL)),
d1 AS (SELECT pool_id, asked, n, {_MEASURES} FROM c1 GROUP BY ALL),
one AS (SELECT pool_id, asked, n, round(1 - expected / n, 6) AS shrink, round(r10, 6) AS resolve10, {_GAIN.format("n")} AS gain FROM d1)"""
_TWO = f"""a2 AS (SELECT pool_id, f, s, {_OF.format("f")} AS va, {_OF.format("s")} AS vb, count(*) AS c, sum(p) AS p FROM z LEFT JOIN wide USING (asin)
  CROSS JOIN (VALUES {", ".join(f"('{a}', '{b}')" for a, b in permutations(ATTRIBUTES, 2))}) t(f, s) GROUP BY ALL),
t2 AS (SELECT pool_id, f, s, va, sum(p) AS tp FROM a2 GROUP BY ALL),
b2 AS (SELECT t.pool_id, t.f, t.s, t.va, any_value(tp) AS tp, a.vb, sum(a.c) AS c, sum(a.p) AS p FROM t2 t JOIN a2 a ON a.pool_id = t.pool_id AND a.f = t.f AND a.s = t.s AND (t.va IS NULL OR a.va IS NULL OR a.va = t.va) GROUP BY ALL),
c2 AS (SELECT *, sum(c) OVER w AS bn, sum(p) OVER w AS mass, coalesce(sum(CASE WHEN vb IS NULL THEN c END) OVER w, 0) AS none FROM b2 WINDOW w AS (PARTITION BY pool_id, f, s, va)),
d2 AS (SELECT pool_id, f, s, va, tp, bn, CASE WHEN vb IS NULL THEN bn ELSE c + none END AS rem, sum(p / mass) AS p FROM c2 WHERE mass > 0 GROUP BY ALL),
e2 AS (SELECT *, round(sum(p) OVER (PARTITION BY pool_id, f, s, va ORDER BY rem), 9) AS cum FROM d2),
f2 AS (SELECT pool_id, f, s, va, tp, bn, {_MEASURES} FROM e2 GROUP BY ALL),
g2 AS (SELECT pool_id, f, va, any_value(tp) AS tp, max({_GAIN.format("bn")}) AS best FROM f2 GROUP BY ALL),
two AS (SELECT pool_id, f AS asked, round(greatest(0, sum(tp * best) - {TURN_COST}), 6) AS two_step FROM g2 GROUP BY ALL)"""
TWO_STEPS_SQL = f"""WITH {CATALOG_SQL}, {_VALUES_SQL}, {_WIDE}, x AS (SELECT lower(category) || '/' || store AS pool_id, asin, ln(1 + rating_number) AS s, count(*) OVER (PARTITION BY lower(category), store) AS n FROM catalog),
y AS (SELECT *, exp(s - max(s) OVER (PARTITION BY pool_id)) AS e FROM x), z AS (SELECT pool_id, asin, n, 0.25 * e / sum(e) OVER (PARTITION BY pool_id) + 0.75 / n AS p FROM y), {_ONE}, {_TWO}
SELECT pool_id, asked, n, gain AS one_step, two_step, n <= {THRESHOLD} AND max(gain) OVER (PARTITION BY pool_id) >= 0 AS looked_at FROM one JOIN two USING (pool_id, asked)"""


def nested_pools(products: DataFrame, sizes=SIZES, samples: int = SAMPLES) -> DataFrame:
    """sample, size, kept (all or deleted), id: for each sample one seeded hash order of the products (id), whose first rows are
    the pool of every size, and without the last tenth of them the pool after a deletion."""
    every = products.select("id", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    every = every.withColumn("order", F.md5(F.concat_ws(":", F.lit("pool"), "sample", "id")))
    every = every.withColumn("head", F.substring("order", 1, 3))
    # how far the first rows reach, from counts by the first digits of the order: only what begins no later is sorted
    heads = every.groupBy("sample", "head").agg(F.count("*").alias("c"))  # 4,096 a sample at most
    reach = heads.withColumn("before", F.sum("c").over(Window.partitionBy("sample").orderBy("head")) - F.col("c")).filter(F.col("before") < max(sizes))
    last = reach.groupBy("sample").agg(F.max("head").alias("last"))
    near = every.join(F.broadcast(last), "sample").filter("head <= last")  # last: a row a sample
    first = near.withColumn("place", F.row_number().over(Window.partitionBy("sample").orderBy("order", "id"))).filter(F.col("place") <= max(sizes)).select("sample", "id", "place")
    have = first.groupBy("sample").agg(F.count("*").alias("have"))
    less = lambda n: n - F.greatest(F.lit(1), F.round(n * DELETED / 100).cast("int"))
    x = first.join(have, "sample").select("sample", "id", "place", "have", F.explode(F.array(*map(F.lit, sizes))).alias("size"))
    n = F.least("size", "have")
    kinds = F.array_compact(F.array(F.when(F.col("place") <= n, "all"), F.when(F.col("place") <= less(n), "deleted")))
    return x.select("sample", "size", F.explode(kinds).alias("kept"), "id")


def question_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By pool size: categories that a pool has and their share of the catalogue, how often its best question is that of the
    largest pool, shrink, resolve and gains of that question, and what changes when a tenth is deleted (Q10)."""
    c = catalog(spark, sf_dir).select(F.col("asin").alias("id"), F.lower("category").alias("category"))
    _, wide = _pools(spark, sf_dir)
    pools = stored(nested_pools(c.select("id")), "nested-pools")
    wide = stored(wide.join(pools.select("id").distinct(), "id", "left_semi"), "pool-values")  # the pools hold a bounded number of products
    name = F.concat_ws("/", "sample", "size", "kept")
    pool = pools.select(name.alias("pool_id"), "id", F.lit(None).cast("double").alias("score"))  # no scores: uniform
    one = stored(spread_signals(remaining(pool, wide)).filter(~F.contains("asked", F.lit("+"))), "pool-signals")
    best = one.groupBy("pool_id").agg(F.max_by(F.struct("asked", "shrink", "resolve10", "finish_gain"), F.struct("shrink", "asked")).alias("b")).select("pool_id", "b.*")
    best = best.join(two_steps(pool, wide), ["pool_id", "asked"])
    part = lambda k: F.split("pool_id", "/")[k]
    best = stored(best.select(part(0).alias("sample"), part(1).cast("int").alias("size"), part(2).alias("kept"), "asked", "shrink", "resolve10", "finish_gain", "two_step"), "choices")
    mass = c.groupBy("category").agg(F.count("*").alias("m"))
    total = c.agg(F.count("*").alias("total"))
    seen = pools.filter("kept = 'all'").join(c, "id").select("sample", "size", "category").distinct().join(mass, "category").groupBy("sample", "size").agg(F.count("*").alias("cats"), F.sum("m").alias("m"))
    seen = seen.join(F.broadcast(total)).groupBy("size").agg(F.round(F.avg("cats"), 4).alias("mean_categories"), F.round(F.avg(F.col("m") / F.col("total")), 4).alias("mean_mass"))  # total: one row
    whole = best.filter("kept = 'all'").drop("kept")
    largest = whole.filter(F.col("size") == max(SIZES)).select("sample", F.col("asked").alias("largest"))
    after = best.filter("kept = 'deleted'").select("sample", "size", *[F.col(n).alias(f"d_{n}") for n in ("asked", "shrink", "resolve10", "finish_gain", "two_step")])
    x = whole.join(largest, "sample").join(after, ["sample", "size"])
    mean = lambda v, n: F.round(F.avg(v), 4).alias(n)
    change = lambda n: F.col(f"d_{n}") - F.col(n)
    out = x.groupBy("size").agg(
        F.count("*").alias("samples"), mean((F.col("asked") == F.col("largest")).cast("double"), "agreement"), mean("shrink", "mean_shrink"), mean("resolve10", "mean_resolve10"), mean("finish_gain", "one_step"), mean("two_step", "two_step"),
        mean((F.col("asked") == F.col("d_asked")).cast("double"), "deletion_agreement"), mean(change("shrink"), "shrink_change"), mean(change("resolve10"), "resolve10_change"), mean(change("finish_gain"), "one_step_change"), mean(change("two_step"), "two_step_change"),
    )
    return out.join(seen, "size")


STABILITY_SQL = f"""WITH {CATALOG_SQL}, {_VALUES_SQL}, {_WIDE}, o AS (SELECT asin, sample, row_number() OVER (PARTITION BY sample ORDER BY md5('pool:' || sample || ':' || asin), asin) AS place, count(*) OVER (PARTITION BY sample) AS have FROM catalog, range({SAMPLES}) t(sample)),
sz AS (SELECT *, least(size, have) AS want FROM o, (SELECT unnest({list(SIZES)}) AS size)),
np AS (SELECT sample, size, 'all' AS kept, asin FROM sz WHERE place <= want UNION ALL SELECT sample, size, 'deleted', asin FROM sz WHERE place <= want - greatest(1, round(want * {DELETED} / 100.0)::INT)),
z AS (SELECT sample || '/' || size || '/' || kept AS pool_id, asin, count(*) OVER (PARTITION BY sample, size, kept) AS n, 1.0::DOUBLE / count(*) OVER (PARTITION BY sample, size, kept) AS p FROM np), {_ONE}, {_TWO},
ch AS (SELECT split_part(pool_id, '/', 1) AS sample, split_part(pool_id, '/', 2)::INT AS size, split_part(pool_id, '/', 3) AS kept, asked, shrink, resolve10, gain, two_step
  FROM (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY shrink DESC, asked DESC) AS k FROM one) JOIN two USING (pool_id, asked) WHERE k = 1),
mm AS (SELECT lower(category) AS category, count(*) AS m FROM catalog GROUP BY 1),
sn AS (SELECT sample, size, count(*) AS cats, sum(m) AS m FROM (SELECT DISTINCT sample, np.size AS size, lower(category) AS category FROM np JOIN catalog USING (asin) WHERE kept = 'all') JOIN mm USING (category) GROUP BY ALL),
sm AS (SELECT size, round(avg(cats), 4) AS mean_categories, round(avg(m / (SELECT count(*) FROM catalog)), 4) AS mean_mass FROM sn GROUP BY 1)
SELECT a.size, count(*) AS samples, round(avg((a.asked = l.asked)::INT), 4) AS agreement, round(avg(a.shrink), 4) AS mean_shrink, round(avg(a.resolve10), 4) AS mean_resolve10, round(avg(a.gain), 4) AS one_step, round(avg(a.two_step), 4) AS two_step,
  round(avg((a.asked = d.asked)::INT), 4) AS deletion_agreement, round(avg(d.shrink - a.shrink), 4) AS shrink_change, round(avg(d.resolve10 - a.resolve10), 4) AS resolve10_change, round(avg(d.gain - a.gain), 4) AS one_step_change,
  round(avg(d.two_step - a.two_step), 4) AS two_step_change, any_value(mean_categories) AS mean_categories, any_value(mean_mass) AS mean_mass
FROM ch a JOIN ch l ON l.sample = a.sample AND l.kept = 'all' AND l.size = {max(SIZES)} JOIN ch d ON d.sample = a.sample AND d.size = a.size AND d.kept = 'deleted' JOIN sm ON sm.size = a.size WHERE a.kept = 'all' GROUP BY a.size"""

QUERIES = {f.__name__: f for f in (finish_gain_two_steps, question_stability)}
SQL = dict(zip(QUERIES, (TWO_STEPS_SQL, STABILITY_SQL), strict=True))
