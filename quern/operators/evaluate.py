"""Session metrics, comparisons, selection rules and usage summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.profile import ranked_values
from quern.sources.views import SESSIONS_SQL, read, sessions

#: The turn of a miss, and the turn from which hits count where the customer overrides an earlier wish.
MISS_TURN, OVERRIDE_TURN = 11, 3


def counts(hit: Column) -> Column:
    return hit & ((F.col("scenario_type") != "intent_override") | (F.col("turn") >= OVERRIDE_TURN))


def outcomes(rows: DataFrame) -> DataFrame:
    """One row a session: first hit turn and the rank at that hit (W10). Where the scenario overrides an earlier wish, hits
    before OVERRIDE_TURN don't count."""
    hit = counts(F.col("hit"))
    return rows.groupBy("sample_id", "scenario_type").agg(F.min(F.when(hit, F.col("turn"))).alias("first_hit_turn"), F.min_by(F.when(hit, F.col("rank")), F.when(hit, F.col("turn"))).alias("hit_rank"))


def metrics(out: DataFrame) -> DataFrame:
    """Hit rate, mean reciprocal rank, mean turns to conversion (a miss is turn 11), efficiency and the composite score,
    by scenario and overall (A22). Parts are rounded before they are combined."""
    hr = F.round(F.avg(F.when(F.col("first_hit_turn").isNotNull(), 1.0).otherwise(0.0)), 6)
    mrr = F.round(F.avg(F.coalesce(1 / F.col("hit_rank"), F.lit(0.0))), 6)
    mttc = F.round(F.avg(F.coalesce("first_hit_turn", F.lit(MISS_TURN)).cast("double")), 6)
    by = out.withColumn("scenario", F.explode(F.array("scenario_type", F.lit("overall")))).groupBy("scenario")
    m = by.agg(F.count("*").alias("n"), hr.alias("hit_rate"), mrr.alias("mrr"), mttc.alias("mttc"))
    efficiency = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (MISS_TURN - F.col("mttc")) / 10))
    return m.withColumn("efficiency", F.round(efficiency, 6)).withColumn("score", F.round(0.5 * F.col("hit_rate") + 0.3 * F.col("mrr") + 0.2 * F.col("efficiency"), 6))


def session_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(outcomes(sessions(spark, sf_dir)))


_OUT = f"""{SESSIONS_SQL}, hs AS (SELECT * REPLACE (hit AND (scenario_type <> 'intent_override' OR turn >= {OVERRIDE_TURN}) AS hit) FROM sess),
o AS (SELECT sample_id, scenario_type, min(CASE WHEN hit THEN turn END) AS ft, arg_min(rank, turn) FILTER (WHERE hit) AS hr FROM hs GROUP BY ALL)"""
_METRICS = """SELECT scenario, count(*) AS n, round(avg((ft IS NOT NULL)::INT), 6) AS hit_rate, round(avg(coalesce(1.0 / hr, 0)), 6) AS mrr, round(avg(coalesce(ft, 11)), 6) AS mttc FROM (SELECT *, unnest([scenario_type, 'overall']) AS scenario FROM {}) GROUP BY 1"""
SESSION_METRICS_SQL = f"""WITH {_OUT}, m AS ({_METRICS.format('o')}), e AS (SELECT *, round(least(1.0, greatest(0.0, (11 - mttc) / 10)), 6) AS efficiency FROM m)
SELECT *, round(0.5 * hit_rate + 0.3 * mrr + 0.2 * efficiency, 6) AS score FROM e"""


def metric_deltas(spark: SparkSession, sf_dir: str, least: float = 0.0) -> DataFrame:
    """Metrics of a variant (even days) against a baseline (odd days), with a screening flag."""
    out = outcomes(sessions(spark, sf_dir)).withColumn("odd", F.substring("sample_id", -1, 1).cast("int") % 2 == 1)
    base, other = metrics(out.filter("odd")), metrics(out.filter("not odd"))
    b = base.select("scenario", F.col("hit_rate").alias("b_hit"), F.col("mrr").alias("b_mrr"))
    j = other.join(b, "scenario")
    return j.select("scenario", F.round(F.col("hit_rate") - F.col("b_hit"), 6).alias("d_hit_rate"), F.round(F.col("mrr") - F.col("b_mrr"), 6).alias("d_mrr"), ((F.col("hit_rate") - F.col("b_hit")) >= least).alias("passes"))


DELTAS_SQL = f"""WITH {_OUT}, a AS ({_METRICS.format("(SELECT * FROM o WHERE right(sample_id, 1)::INT % 2 = 1)")}), b AS ({_METRICS.format("(SELECT * FROM o WHERE right(sample_id, 1)::INT % 2 = 0)")})
SELECT scenario, round(b.hit_rate - a.hit_rate, 6) AS d_hit_rate, round(b.mrr - a.mrr, 6) AS d_mrr, b.hit_rate - a.hit_rate >= 0 AS passes FROM a JOIN b USING (scenario)"""


def one_se_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-standard-error selection: of the configurations within one standard error of the best, the simplest.
    Here a configuration is an event type and its complexity its name's length; scores are per user."""
    e = read(spark, sf_dir, "events")
    per_user = e.groupBy("event_type", "user_id").agg(F.avg("value").alias("v"))
    stats = per_user.groupBy("event_type").agg(F.avg("v").alias("mean"), (F.stddev_samp("v") / F.sqrt(F.count("*"))).alias("se"))
    best = stats.agg(F.max_by(F.struct("mean", "se"), F.struct("mean", "event_type")).alias("b")).first()["b"]  # one row
    bar = (best["mean"] - (best["se"] or 0.0)) if best else 0.0
    near = stats.withColumn("eligible", F.col("mean") >= F.lit(bar))
    pick = near.filter("eligible").agg(F.min_by("event_type", F.struct(F.length("event_type"), "event_type")).alias("c")).first()["c"]
    return near.select("event_type", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"), "eligible", (F.col("event_type") == F.lit(pick)).alias("chosen"))


ONE_SE_SQL = """WITH u AS (SELECT event_type, user_id, avg(value) AS v FROM events GROUP BY ALL), s AS (SELECT event_type, avg(v) AS mean, stddev_samp(v) / sqrt(count(*)) AS se FROM u GROUP BY 1),
b AS (SELECT mean - se AS bar FROM s ORDER BY mean DESC, event_type DESC LIMIT 1), n AS (SELECT s.*, mean >= bar AS eligible FROM s, b)
SELECT event_type, round(mean, 6) AS mean, round(se, 6) AS se, eligible, event_type = (SELECT event_type FROM n WHERE eligible ORDER BY length(event_type), event_type LIMIT 1) AS chosen FROM n"""


def paired_bootstrap(spark: SparkSession, sf_dir: str, rounds: int = 200, seed: int = 7) -> DataFrame:
    """Interval of the mean hit rate of one configuration; bootstrap_difference() compares two."""
    out = outcomes(sessions(spark, sf_dir)).withColumn("y", F.when(F.col("first_hit_turn").isNotNull(), 1.0).otherwise(0.0))
    return bootstrap(out, rounds, seed)


def bootstrap(out: DataFrame, rounds: int = 200, seed: int = 7) -> DataFrame:
    """Interval of the mean of y from Poisson bootstrap weights hashed by (seed, round, session): no resampled rows are made
    beyond round sums, each session adds its weight to every round."""
    cdf, p, total = [], 0.36787944117144233, 0.0
    for k in range(9):
        total += p
        cdf.append(total)
        p /= k + 1
    draws = out.select("y", "sample_id", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "round", "sample_id")), 1, 12), 16, 10).cast("double") / float(1 << 48)
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in cdf), F.lit(0))
    means = draws.withColumn("w", weight).groupBy("round").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("m"))
    return means.agg(F.count("*").alias("rounds"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.expr("percentile_disc(0.025) within group (order by m)"), 6).alias("low"), F.round(F.expr("percentile_disc(0.975) within group (order by m)"), 6).alias("high"))


BOOTSTRAP_SQL = f"""WITH RECURSIVE {_OUT}, k(i, p, c) AS (SELECT 0, 0.36787944117144233::DOUBLE, 0.36787944117144233::DOUBLE UNION ALL SELECT i + 1, p / (i + 1), c + p / (i + 1) FROM k WHERE i < 8),
d AS (SELECT (ft IS NOT NULL)::INT AS y, r AS round, ('0x' || substr(md5('7:' || r || ':' || sample_id), 1, 12))::BIGINT / {1 << 48}.0 AS u FROM o, range(1, 201) AS t(r)),
w AS (SELECT round, y, (SELECT count(*) FROM k WHERE u >= c) AS w FROM d), m AS (SELECT round, sum(w * y) / sum(w) AS m FROM w GROUP BY 1)
SELECT count(*) AS rounds, round(avg(m), 6) AS mean, round(quantile_disc(m, 0.025), 6) AS low, round(quantile_disc(m, 0.975), 6) AS high FROM m"""


#: The narrower of the two compared configurations releases this many results a turn.
NARROW = 3


def paired(rows: DataFrame) -> DataFrame:
    """sample_id, y: hit of the full list less hit of its first NARROW results, of each session."""
    hit = lambda c: F.max(F.when(c, 1.0).otherwise(0.0))
    return rows.groupBy("sample_id").agg((hit(counts(F.col("hit"))) - hit(counts(F.col("hit")) & (F.col("rank") <= NARROW))).alias("y"))


def bootstrap_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the mean paired difference of two configurations over the same sessions."""
    return bootstrap(paired(sessions(spark, sf_dir)))


DIFFERENCE_SQL = f"""WITH RECURSIVE {SESSIONS_SQL}, hs AS (SELECT * REPLACE (hit AND (scenario_type <> 'intent_override' OR turn >= {OVERRIDE_TURN}) AS hit) FROM sess),
o AS (SELECT sample_id, max((hit IS TRUE)::INT) - max(((hit AND rank <= {NARROW}) IS TRUE)::INT) AS y FROM hs GROUP BY 1), k(i, p, c) AS (SELECT 0, 0.36787944117144233::DOUBLE, 0.36787944117144233::DOUBLE UNION ALL SELECT i + 1, p / (i + 1), c + p / (i + 1) FROM k WHERE i < 8),
d AS (SELECT y, r AS round, ('0x' || substr(md5('7:' || r || ':' || sample_id), 1, 12))::BIGINT / {1 << 48}.0 AS u FROM o, range(1, 201) AS t(r)),
w AS (SELECT round, y, (SELECT count(*) FROM k WHERE u >= c) AS w FROM d), m AS (SELECT round, sum(w * y) / sum(w) AS m FROM w GROUP BY 1)
SELECT count(*) AS rounds, round(avg(m), 6) AS mean, round(quantile_disc(m, 0.025), 6) AS low, round(quantile_disc(m, 0.975), 6) AS high FROM m"""


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic sample of fixed sizes by scenario: the smallest seeded hashes of each stratum."""
    sizes = F.create_map(*[F.lit(x) for kv in (("buying", 8), ("browsing", 8), ("intent_override", 3), ("boundary", 1)) for x in kv])
    ids = sessions(spark, sf_dir).select("sample_id", "scenario_type").distinct().withColumn("h", F.md5(F.concat(F.lit("s:"), "sample_id")))
    ranked = ids.withColumn("place", F.row_number().over(Window.partitionBy("scenario_type").orderBy("h")))
    return ranked.filter((F.col("place") <= 8) & (F.col("place") <= sizes[F.col("scenario_type")])).select("sample_id", "scenario_type", "place")


SAMPLE_SQL = f"""WITH {SESSIONS_SQL}, d AS (SELECT DISTINCT sample_id, scenario_type FROM sess), r AS (SELECT *, row_number() OVER (PARTITION BY scenario_type ORDER BY md5('s:' || sample_id)) AS place FROM d)
SELECT sample_id, scenario_type, place FROM r WHERE place <= CASE scenario_type WHEN 'buying' THEN 8 WHEN 'browsing' THEN 8 WHEN 'intent_override' THEN 3 ELSE 1 END"""

#: Price of a thousand tokens by provider (event type); the others are free and offline.
PRICES = {"purchase": 0.5, "signup": 0.2}


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    tokens = F.greatest(F.lit(0), F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0)))
    return e.select(F.col("event_type").alias("provider"), F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")).alias("session_id"), "event_id", "ts", F.col("value").alias("latency_ms"), tokens.alias("tokens"))


def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, tokens, cost and share of online turns by provider."""
    price = F.coalesce(F.create_map(*[F.lit(x) for kv in PRICES.items() for x in kv])[F.col("provider")], F.lit(0.0))
    e = usage_events(spark, sf_dir).withColumn("cost", F.col("tokens") * price / 1000)
    return e.groupBy("provider").agg(F.count("*").alias("turns"), F.count_distinct("session_id").alias("sessions"), F.sum("tokens").cast("bigint").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"), F.max((price > 0)).alias("online"))


_USAGE = """ev AS (SELECT event_type AS provider, user_id || '-' || strftime(ts, '%Y%m%d') AS session_id, event_id, value AS latency_ms, greatest(0, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0)) AS tokens FROM events)"""
USAGE_SQL = f"""WITH {_USAGE} SELECT provider, count(*) AS turns, count(DISTINCT session_id) AS sessions, sum(tokens)::BIGINT AS tokens, round(sum(tokens * CASE provider WHEN 'purchase' THEN 0.5 WHEN 'signup' THEN 0.2 ELSE 0 END::DOUBLE / 1000), 6) AS cost, provider IN ('purchase', 'signup') AS online FROM ev GROUP BY provider"""


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank p50 and p95 by provider (A26), exact."""
    e = usage_events(spark, sf_dir)
    at = ranked_values(e, ["provider"], "latency_ms", {"p50": lambda n: F.ceil(0.5 * n), "p95": lambda n: F.ceil(0.95 * n)})
    return at.select("provider", "p50", "p95")


LATENCY_SQL = f"WITH {_USAGE} SELECT provider, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95 FROM ev GROUP BY provider"


def dedup_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response a session and message: the first event of each session and provider."""
    e = usage_events(spark, sf_dir)
    first = e.groupBy("session_id", "provider").agg(F.min("event_id").alias("event_id"), F.count("*").alias("n_seen"))
    return first


DEDUP_SQL = f"WITH {_USAGE} SELECT session_id, provider, min(event_id) AS event_id, count(*) AS n_seen FROM ev GROUP BY ALL"


KEPT_SESSIONS = 50


def latest_sessions(events: DataFrame, k: int = KEPT_SESSIONS) -> DataFrame:
    """The latest k sessions of each user with their retention rank; a session is a user's day."""
    day = events.withColumn("session_id", F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")))
    last = day.groupBy("user_id", "session_id").agg(F.max("ts").alias("last_ts"), F.count("*").alias("n_events"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("last_ts"), F.desc("session_id")))
    return last.withColumn("place", place).filter(F.col("place") <= k).select("user_id", "session_id", "place", "n_events")


def session_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_sessions(read(spark, sf_dir, "events"))


RETENTION_SQL = f"""SELECT user_id, session_id, place, n_events FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_ts DESC, session_id DESC) AS place FROM
(SELECT user_id, user_id || '-' || strftime(ts, '%Y%m%d') AS session_id, max(ts) AS last_ts, count(*) AS n_events FROM events GROUP BY 1, 2)) WHERE place <= {KEPT_SESSIONS}"""


def turn_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of the value from the turn before within a session, and the runs of one event type."""
    e = read(spark, sf_dir, "events").withColumn("session_id", F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")))
    w = Window.partitionBy("session_id").orderBy("ts", "event_id")
    x = e.withColumn("turn", F.row_number().over(w)).withColumn("change", F.round(F.col("value") - F.lag("value").over(w), 6)).withColumn("new", F.when(F.lag("event_type").over(w) == F.col("event_type"), 0).otherwise(1))
    x = x.withColumn("run", F.sum("new").over(w))
    long = x.groupBy("session_id", "run").agg(F.count("*").alias("len")).groupBy("session_id").agg(F.max("len").alias("longest_run"))
    return x.join(long, "session_id").select("event_id", "session_id", "turn", "change", "longest_run")


PROGRESS_SQL = """WITH x AS (SELECT event_id, user_id || '-' || strftime(ts, '%Y%m%d') AS session_id, ts, value, event_type FROM events),
y AS (SELECT *, row_number() OVER w AS turn, round(value - lag(value) OVER w, 6) AS change, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM x WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)),
z AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS run FROM y), l AS (SELECT session_id, max(n) AS longest_run FROM (SELECT session_id, run, count(*) AS n FROM z GROUP BY ALL) GROUP BY 1)
SELECT event_id, session_id, turn, change, longest_run FROM z JOIN l USING (session_id)"""

QUERIES = {f.__name__: f for f in (session_metrics, metric_deltas, one_se_choice, paired_bootstrap, stratified_sample, usage_summary, latency_percentiles, dedup_messages, turn_progress, bootstrap_difference, session_retention)}
SQL = dict(zip(QUERIES, (SESSION_METRICS_SQL, DELTAS_SQL, ONE_SE_SQL, BOOTSTRAP_SQL, SAMPLE_SQL, USAGE_SQL, LATENCY_SQL, DEDUP_SQL, PROGRESS_SQL, DIFFERENCE_SQL, RETENTION_SQL), strict=True))
