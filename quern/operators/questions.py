"""The question value of attributes and pairs of attributes in a pool of candidates, and the choice of a question by turn."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.dialogue import _STATES, operations, turn_states
from quern.operators.signals import _VALUES_SQL, CATEGORY_SIGNALS_SQL, PRIORS, attribute_values, category_signals, weights
from quern.sources.staging import stored
from quern.sources.views import CATALOG_SQL, catalog

ATTRIBUTES = tuple(PRIORS)
#: Single attributes, then pairs, as (first, second or None).
ASKABLE = tuple((a, None) for a in ATTRIBUTES) + tuple(combinations(ATTRIBUTES, 2))
ANY, NONE = "*", "-"


def _name(pair: tuple[str, str | None]) -> str:
    return "+".join(filter(None, pair))


def remaining(pool: DataFrame, wide: DataFrame, alpha: float = 0.25) -> DataFrame:
    """pool_id, asked, n, rem, p, covered: how the number of candidates that stay compatible with the target spreads, for each
    attribute and each pair of attributes (J11).

    pool: pool_id, id, score; wide: id, vals (map of attribute to value). Candidates are counted by value pairs, and the
    counts are summed to margins: a target that lacks a value takes any, one that has it takes its own and those without.
    What is joined are counts of the distinct values of a pool, never two candidates. A candidate outside wide has no
    values; an attribute that nobody has leaves all."""
    key = lambda a: F.concat(F.lit("v:"), F.try_element_at("vals", F.lit(a))) if a else F.lit(None).cast("string")
    asked = F.explode(F.array(*[F.struct(F.lit(_name(s)).alias("asked"), key(s[0]).alias("a"), key(s[1]).alias("b")) for s in ASKABLE]))
    rows = weights(pool, alpha).join(wide, "id", "left").select("pool_id", "n", "p", asked.alias("x"))
    counts = rows.groupBy("pool_id", "n", "x.asked", "x.a", "x.b").agg(F.count("*").alias("c"), F.sum("p").alias("p"))
    a, b = F.coalesce("a", F.lit(NONE)), F.coalesce("b", F.lit(NONE))
    cell = lambda x, y: F.struct(x.alias("ka"), y.alias("kb"))
    margins = counts.select("pool_id", "asked", "c", F.explode(F.array(cell(a, b), cell(a, F.lit(ANY)), cell(F.lit(ANY), b))).alias("k"))
    margins = margins.groupBy("pool_id", "asked", "k.ka", "k.kb").agg(F.sum("c").alias("m"))
    none, every = F.lit(NONE), F.lit(ANY)
    both = F.array(cell(a, b), cell(a, none), cell(none, b), cell(none, none))
    cells = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), both).when(F.col("a").isNotNull(), F.array(cell(a, every), cell(none, every))).when(F.col("b").isNotNull(), F.array(cell(every, b), cell(every, none)))
    needs = counts.filter("a is not null or b is not null").select("pool_id", "asked", "n", "a", "b", "p", F.explode(cells).alias("k")).select("*", "k.ka", "k.kb")
    got = needs.join(margins, ["pool_id", "asked", "ka", "kb"], "left").groupBy("pool_id", "asked", "n", "a", "b").agg(F.sum("m").alias("rem"), F.first("p").alias("p"))
    rest = counts.filter("a is null and b is null").select("pool_id", "asked", "n", F.col("n").alias("rem"), "p", F.lit(0.0).alias("covered"))
    known = got.select("pool_id", "asked", "n", "rem", "p", F.col("p").alias("covered"))
    return known.unionByName(rest).groupBy("pool_id", "asked", "n", "rem").agg(F.sum("p").alias("p"), F.sum("covered").alias("covered"))


def finish_gain(r10: Column, r3: Column, r1: Column, expected: Column, p90: Column, n: Column) -> Column:
    """How far a question brings the pool to ten candidates or fewer (Q5). A pool of ten has no way left: progress 0."""
    progress = F.when(n <= 10, 0.0).otherwise(1 - F.log1p(F.greatest(expected - 10, F.lit(0.0))) / F.log1p(n - 10))
    return 0.5 * r10 + 0.2 * r3 + 0.1 * r1 + 0.3 * progress - 0.2 * p90 / n


def spread_signals(spread: DataFrame) -> DataFrame:
    """The measures of Q2 and Q5 from remaining(). A pool has at most about sqrt(2 n) different counts for one attribute, so
    the window for the weighted p90 stays small."""
    w = Window.partitionBy("pool_id", "asked").orderBy("rem")
    x = spread.withColumn("cum", F.round(F.sum("p").over(w), 9))
    within = lambda k: F.sum(F.when(F.col("rem") <= k, F.col("p")).otherwise(0.0))
    s = x.groupBy("pool_id", "asked", "n").agg(
        F.sum(F.col("p") * F.col("rem")).alias("expected"), within(10).alias("r10"), within(3).alias("r3"), within(1).alias("r1"), F.sum("covered").alias("coverage"),
        F.min(F.when(F.col("cum") >= 0.9, F.col("rem"))).alias("p90"), F.max("rem").alias("worst"),
    )
    gain = finish_gain(F.col("r10"), F.col("r3"), F.col("r1"), F.col("expected"), F.col("p90"), F.col("n"))
    return s.select(
        "pool_id", "asked", F.round("expected", 4).alias("expected"), F.round(1 - F.col("expected") / F.col("n"), 6).alias("shrink"), F.round("r10", 6).alias("resolve10"), F.round("r3", 6).alias("resolve3"),
        F.round("r1", 6).alias("resolve1"), F.round("coverage", 6).alias("coverage"), "p90", "worst", F.round(gain, 6).alias("finish_gain"),
    )


def _pools(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = catalog(spark, sf_dir)
    pool = c.select(F.lower("category").alias("pool_id"), F.col("asin").alias("id"), F.log1p(F.col("rating_number").cast("double")).alias("score"))
    values = attribute_values(c)
    return pool, values.groupBy(F.col("asin").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("attribute", "value"))).alias("vals"))


def question_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures of every attribute and pair of attributes for the pool of each product type (Q2, Q5)."""
    return spread_signals(remaining(*_pools(spark, sf_dir)))


_VALUE_OF = "CASE s.{0} " + " ".join(f"WHEN '{a}' THEN {a}_v" for a in ATTRIBUTES) + " END"
_SIGNALS_SQL = f"""WITH {CATALOG_SQL}, {_VALUES_SQL},
x AS (SELECT lower(category) AS pool_id, asin, ln(1 + rating_number) AS s, count(*) OVER (PARTITION BY lower(category)) AS n FROM catalog), y AS (SELECT *, exp(s - max(s) OVER (PARTITION BY pool_id)) AS e FROM x),
z AS (SELECT *, 0.25 * e / sum(e) OVER (PARTITION BY pool_id) + 0.75 / n AS p FROM y),
wide AS (SELECT asin, {", ".join(f"max(CASE attribute WHEN '{a}' THEN value END) AS {a}_v" for a in ATTRIBUTES)} FROM val GROUP BY asin),
s(asked, a, b) AS (VALUES {", ".join(f"('{_name(x)}', '{x[0]}', " + (f"'{x[1]}')" if x[1] else "NULL)") for x in ASKABLE)}),
t AS (SELECT z.pool_id, z.asin, n, p, asked, {_VALUE_OF.format("a")} AS va, {_VALUE_OF.format("b")} AS vb FROM z LEFT JOIN wide USING (asin) CROSS JOIN s),
r AS (SELECT t.pool_id, t.asked, t.asin, any_value(t.n) AS n, any_value(t.p) AS p, any_value(t.va IS NOT NULL OR t.vb IS NOT NULL) AS has, count(*) AS rem FROM t JOIN t u ON t.pool_id = u.pool_id AND t.asked = u.asked
  AND (t.va IS NULL OR u.va IS NULL OR t.va = u.va) AND (t.vb IS NULL OR u.vb IS NULL OR t.vb = u.vb) GROUP BY ALL),
d AS (SELECT pool_id, asked, n, rem, sum(p) AS p, sum(CASE WHEN has THEN p ELSE 0 END) AS covered FROM r GROUP BY ALL),
c AS (SELECT *, round(sum(p) OVER (PARTITION BY pool_id, asked ORDER BY rem), 9) AS cum FROM d),
g AS (SELECT pool_id, asked, n, sum(p * rem) AS expected, sum(CASE WHEN rem <= 10 THEN p ELSE 0 END) AS r10, sum(CASE WHEN rem <= 3 THEN p ELSE 0 END) AS r3, sum(CASE WHEN rem <= 1 THEN p ELSE 0 END) AS r1,
  sum(covered) AS coverage, min(rem) FILTER (WHERE cum >= 0.9) AS p90, max(rem) AS worst FROM c GROUP BY ALL),
sig AS (SELECT pool_id, asked, round(expected, 4) AS expected, round(1 - expected / n, 6) AS shrink, round(r10, 6) AS resolve10, round(r3, 6) AS resolve3, round(r1, 6) AS resolve1, round(coverage, 6) AS coverage, p90, worst,
  round(0.5 * r10 + 0.2 * r3 + 0.1 * r1 + 0.3 * CASE WHEN n <= 10 THEN 0 ELSE 1 - ln(1 + greatest(expected - 10, 0)) / ln(1 + n - 10) END - 0.2 * p90 / n, 6) AS finish_gain FROM g)"""
QUESTION_SQL = f"{_SIGNALS_SQL} SELECT * FROM sig"


def best_attribute_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair of attributes that shrinks each pool most, the first of equals (Q3)."""
    place = F.create_map(*[F.lit(x) for i, s in enumerate(ASKABLE) for x in (_name(s), -i)])
    pairs = question_signals(spark, sf_dir).filter(F.contains("asked", F.lit("+")))
    best = pairs.groupBy("pool_id").agg(F.max_by(F.struct("asked", "shrink", "resolve10"), F.struct("shrink", place[F.col("asked")].alias("i"))).alias("b"))
    return best.select("pool_id", "b.asked", "b.shrink", "b.resolve10")


_PLACE = "CASE asked " + " ".join(f"WHEN '{_name(s)}' THEN {i}" for i, s in enumerate(ASKABLE)) + " END"
PAIR_SQL = f"""{_SIGNALS_SQL} SELECT pool_id, asked, shrink, resolve10 FROM (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY shrink DESC, {_PLACE}) AS k FROM sig WHERE contains(asked, '+')) WHERE k = 1"""

#: Attribute of the dialogue states by that of the catalogue signals.
CLASS_OF = {"color_word": "color", "size": "size", "store": "brand"}
#: Questions of a session, its last turn, least ask utility, stop utility.
MAX_QUESTIONS, MAX_TURN, LEAST_ASK, STOP_AT = 3, 10, 0.2, 0.65
REASONS = ("no_more_preferences", "max_questions", "turn_limit", "stop_utility_reached", "ask_utility_too_low", "highest_ask_utility")
#: Ask utilities are rounded to nine places; attributes that can be asked about are fewer than PLACES.
UNIT, PLACES = 1_000_000_000, 16


def decide(turns: DataFrame, signals: DataFrame) -> DataFrame:
    """Ask or stop at each turn, why, and what.

    turns: session_id, turn, category, known, set_attributes, declined (arrays), no_more, confidence; signals as of
    category_signals(). Guards come first (no more preferences, questions used up, last turn), then the stop utility, then
    the attribute of the largest ask utility, the first of equals. A category without signals takes those of all products.

    A question that was asked counts from the next turn on. A decision hangs on the earlier ones by the set of asked
    attributes alone, which grows at most MAX_QUESTIONS times: so each utility is taken once for an attribute that was asked
    and one that wasn't, and a window a question finds the turn of a session that asks the next new attribute."""
    sig = F.struct("gain", "answer_probability")
    most = 0.3 * F.col("gain") + 0.15 * F.col("answer_probability")  # of categories that differ by case
    by = signals.groupBy(F.lower("category").alias("category")).agg(F.struct(*[F.max_by(F.when(F.col("attribute") == a, sig), F.when(F.col("attribute") == a, most)).alias(a) for a in CLASS_OF]).alias("sig"))
    have = turns.join(by, "category", "left").withColumn("every", F.lit("__all__"))
    have = have.join(F.broadcast(by.filter("category = '__all__'").select(F.col("category").alias("every"), F.col("sig").alias("all_sig"))), "every", "left")  # one row
    full = lambda v: F.least(F.lit(1.0), v)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    late, vague = (F.col("turn") - 1) / 9.0, flag(F.col("confidence") < 0.65)

    def base(a):
        s, own = F.coalesce("sig", "all_sig")[a], F.lit(CLASS_OF[a])
        return 0.3 * s["gain"] + 0.25 * flag(~F.array_contains("set_attributes", own)) + 0.15 * s["answer_probability"] + 0.2 * vague

    def worth(a, i, asked):
        """Whole 1e-9 of the ask utility times PLACES, plus a place: the largest is that of the first of equals. A long is compared
        faster than a struct, and the expressions stay small enough to be compiled."""
        value = F.round(F.col(f"base_{a}") - 0.4 * asked - F.col(f"declined_{a}") - 0.15 * late, 9)
        return F.round(value * UNIT).cast("bigint") * PLACES + (PLACES - 1 - i)

    def stop(n):
        return F.round(F.col("stop_base") + 0.15 * full(F.lit(n / MAX_QUESTIONS)) + F.col("stop_turn") - 0.3 * vague, 6)

    names, least = list(CLASS_OF), min(MAX_QUESTIONS, len(CLASS_OF))
    declined = [(0.6 * flag(F.array_contains("declined", F.lit(CLASS_OF[a])))).alias(f"declined_{a}") for a in names]
    x = have.select("session_id", "turn", "no_more", "confidence", *[base(a).alias(f"base_{a}") for a in names], *declined, (0.35 * full(F.col("known") / 4.0) + 0.25 * F.col("confidence")).alias("stop_base"), (0.25 * full(F.col("turn") / 10.0)).alias("stop_turn"))
    x = x.select("session_id", "turn", "no_more", *[worth(a, i, float(k)).alias(f"{a}_{k}") for i, a in enumerate(names) for k in (0, 1)], *[stop(n).alias(f"stop_{n}") for n in range(least + 1)])
    # next_n: turn and place of the question for attribute n + 1; reason, top and stop: by what was asked before the turn
    place_of = lambda packed: (PLACES - 1 - packed % PLACES).cast("int")
    known = []
    for n in range(least + 1):
        was = lambda i, ks=tuple(known): reduce(lambda p, k: p | (F.col(k) % PLACES == i), ks, F.lit(False))
        x = x.withColumn("after", F.coalesce(F.expr(f"next_{n - 1} div {PLACES}") < F.col("turn"), F.lit(False)) if n else F.lit(True))
        x = x.withColumn("here", F.greatest(*[F.when(F.coalesce(was(i), F.lit(False)), F.col(f"{a}_1")).otherwise(F.col(f"{a}_0")) for i, a in enumerate(names)]))
        reason = (
            F.when(F.col("no_more"), REASONS.index("no_more_preferences")).when(F.lit(n >= MAX_QUESTIONS), REASONS.index("max_questions")).when(F.col("turn") >= MAX_TURN, REASONS.index("turn_limit"))
            .when(F.col(f"stop_{n}") >= STOP_AT, REASONS.index("stop_utility_reached")).when(F.floor(F.col("here") / PLACES) < round(LEAST_ASK * UNIT), REASONS.index("ask_utility_too_low")).otherwise(REASONS.index("highest_ask_utility"))
        )
        fresh = {"reason": reason, "top": F.col("here"), "stop": F.col(f"stop_{n}")}
        x = x.withColumns({k: F.when(F.col("after"), v).otherwise(F.col(k)) if n else v for k, v in fresh.items()})
        if n < least:
            q = place_of(F.pmod("top", F.lit(PLACES)))
            new = F.col("after") & (F.col("reason") == REASONS.index("highest_ask_utility")) & F.col("top").isNotNull() & ~F.coalesce(was(q), F.lit(False))
            known.append(f"next_{n}")
            x = x.withColumn(known[-1], F.min(F.when(new, F.col("turn").cast("bigint") * PLACES + q)).over(Window.partitionBy("session_id")))
    asked = F.when(F.col("reason") == REASONS.index("highest_ask_utility"), F.get(F.array(*map(F.lit, names)), place_of(F.pmod("top", F.lit(PLACES)))))
    return x.select("session_id", "turn", F.array(*map(F.lit, REASONS))[F.col("reason")].alias("reason"), asked.alias("asked"), (F.floor(F.col("top") / PLACES) / UNIT).alias("ask_utility"), F.col("stop").alias("stop_utility"))


def question_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """decide() for every turn of every session."""
    s = turn_states(operations(spark, sf_dir))
    t = s.select("session_id", "turn", F.coalesce("category", F.lit("__all__")).alias("category"), F.size("cons").alias("known"), F.col("cons.attribute").alias("set_attributes"), "declined", "no_more", "confidence")
    return decide(t, stored(category_signals(spark, sf_dir), "category-signals"))  # so its size is known, and a small one goes to the turns


_CLASS = "CASE x.attribute " + " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in CLASS_OF.items()) + " END"
_I = "CASE x.attribute " + " ".join(f"WHEN '{a}' THEN {i}" for i, a in enumerate(CLASS_OF)) + " END"
_UTILITIES = f"""list_sort(list_transform(sig, lambda x: {{'u': -round(0.3 * x.gain + CASE WHEN list_contains(had, {_CLASS}) THEN 0 ELSE 0.25 END + 0.15 * x.answer_probability + 0.2 * vague
  - CASE WHEN list_contains(asked, {_CLASS}) THEN 0.4 ELSE 0 END - CASE WHEN list_contains(declined, {_CLASS}) THEN 0.6 ELSE 0 END - 0.15 * (turn - 1) / 9.0, 9), 'i': {_I}, 'attribute': x.attribute, 'class': {_CLASS}}}))[1]"""
DECISIONS_SQL = f"""WITH RECURSIVE {_STATES}, sg AS ({CATEGORY_SIGNALS_SQL}), sl AS (SELECT lower(category) AS category, list({{'attribute': attribute, 'gain': gain, 'answer_probability': answer_probability}}) AS sig FROM sg GROUP BY 1),
tt AS (SELECT session_id, turn, len(cons) AS known, list_transform(cons, lambda c: c.attribute) AS had, declined, no_more, confidence, CASE WHEN confidence < 0.65 THEN 1.0 ELSE 0.0 END AS vague, coalesce(a.sig, (SELECT sig FROM sl WHERE category = '__all__')) AS sig
  FROM states LEFT JOIN sl a ON a.category = coalesce(states.category, '__all__')),
dc AS (SELECT session_id, 0 AS turn, []::VARCHAR[] AS asked, NULL::VARCHAR AS reason, NULL::VARCHAR AS q, 0.0::DOUBLE AS u, 0.0::DOUBLE AS stop FROM (SELECT DISTINCT session_id FROM states)
  UNION ALL
  SELECT session_id, turn, CASE WHEN reason = 'highest_ask_utility' AND NOT list_contains(asked, top.class) THEN list_append(asked, top.class) ELSE asked END, reason, CASE WHEN reason = 'highest_ask_utility' THEN top.attribute END, -top.u, stop
  FROM (SELECT *, CASE WHEN no_more THEN 'no_more_preferences' WHEN len(asked) >= {MAX_QUESTIONS} THEN 'max_questions' WHEN turn >= {MAX_TURN} THEN 'turn_limit' WHEN stop >= {STOP_AT} THEN 'stop_utility_reached' WHEN -top.u < {LEAST_ASK} THEN 'ask_utility_too_low' ELSE 'highest_ask_utility' END AS reason
    FROM (SELECT *, {_UTILITIES} AS top, round(0.35 * least(1, known / 4.0) + 0.25 * confidence + 0.15 * least(1, len(asked) / {MAX_QUESTIONS}.0) + 0.25 * least(1, turn / 10.0) - 0.3 * vague, 6)::DOUBLE AS stop
      FROM (SELECT t.*, dc.asked FROM dc JOIN tt t ON t.session_id = dc.session_id AND t.turn = dc.turn + 1))))
SELECT session_id, turn, reason, q AS asked, u AS ask_utility, stop AS stop_utility FROM dc WHERE turn > 0"""


def question_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by reason and asked attribute, with the share of all turns."""
    d = stored(question_decisions(spark, sf_dir).groupBy("reason", "asked").agg(F.count("*").alias("n")), "decisions")  # read twice
    total = d.agg(F.sum("n").alias("total"))  # one row
    return d.join(F.broadcast(total)).select("reason", "asked", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


STATISTICS_SQL = f"""WITH d AS ({DECISIONS_SQL}) SELECT reason, asked, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM d GROUP BY reason, asked"""

QUERIES = {f.__name__: f for f in (question_signals, best_attribute_pair, question_decisions, question_statistics)}
SQL = dict(zip(QUERIES, (QUESTION_SQL, PAIR_SQL, DECISIONS_SQL, STATISTICS_SQL), strict=True))
