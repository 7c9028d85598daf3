"""Messages to recognised operations, operations folded into dialogue states, and what follows from a state.

Messages are the customers' turns of the conversations table. Operations (what a turn adds, replaces, removes, declines or
rejects) are read from order lines: an order is a session, its lines are the turns, and a line's product, flags and
amounts say what the turn does. Sessions are short by their key, so a fold over one is a fold over a few rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.sources.staging import spread
from quern.sources.views import read

#: Settings: act, the cue words that say it (in the languages of the messages), how many words after the cue are its value, and
#: confidence; the first act that fits decides. Another shop's cues are another table of this form.
RULES = (
    ("replace", "from|von|desde|depuis", 2, 0.95),
    ("no_more", "that is|is that|das ist|es que", 0, 0.98),
    ("no_preference", "no|nicht|pas|sin", 1, 0.95),
    ("hard", "with|con|mit|avec", 2, 0.92),
    ("soft", "for|para|pour", 2, 0.92),
    ("reject", "this|dieser|esta", 1, 0.85),
    ("search", "to|zu|que", 2, 0.85),
)
NEGATIVE = ("no_preference", "reject")
HARD_CUE = r"(?:^|[\s.,;:!?])(?:must|only|as|auf|en)\s"
TAIL = r"(?s)^[^.!?]*[.!?]\s*(.{3,180})"


def cue_pattern(cues: str, n_words: int) -> str:
    """A cue as words of its own, and the words after it in group 1."""
    return rf"(?:^|[\s.,;:!?])(?:{cues})((?:\s+[a-z]+){{1,{n_words}}})" if n_words else rf"(?:^|[\s.,;:!?])((?:{cues}))(?:[\s.,;:!?]|$)"


def recognise(message: Column, rules: tuple = RULES) -> tuple[Column, Column, Column]:
    """Act, value and confidence of a message; ambiguous at 0.35 if nothing fits."""
    low = F.lower(message)
    act, value, sure = F.lit("ambiguous"), F.lit(None).cast("string"), F.lit(0.35)
    for name, cues, n_words, confidence in reversed(rules):
        pattern = cue_pattern(cues, n_words)
        fits = low.rlike(pattern)
        act, sure = F.when(fits, F.lit(name)).otherwise(act), F.when(fits, F.lit(confidence)).otherwise(sure)
        value = F.when(fits, F.trim(F.regexp_extract(low, pattern, 1))).otherwise(value)
    return act, value, sure


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, turn (from 1), message: the customers' turns of all conversations."""
    c = read(spark, sf_dir, "conversations").filter("role = 'user'")
    turn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    return c.select(F.col("conv_id").alias("session_id"), turn.alias("turn"), F.coalesce("text", F.lit("")).alias("message"))


def recognise_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised act, value, attribute and confidence of every customer turn, the tail of the first message as a soft
    constraint, and whether a second opinion is due: little confidence, an ambiguous or replacing act, a hard cue, or a
    new constraint after the first turn (D1, D2, D3, D9, T14)."""
    m = messages(spark, sf_dir)
    act, value, sure = recognise(F.col("message"))
    x = m.select("session_id", "turn", "message", act.alias("act"), value.alias("value"), sure.alias("confidence"))
    tail = F.when(F.col("turn") == 1, F.nullif(F.trim(F.regexp_extract(F.lower("message"), TAIL, 1)), F.lit("")))
    second = (F.col("confidence") < 0.8) | F.col("act").isin("ambiguous", "replace") | F.lower("message").rlike(HARD_CUE) | ((F.col("turn") >= 2) & F.col("act").isin("hard", "soft"))
    return x.select("session_id", "turn", "act", "value", T.classify_attribute(F.coalesce(value, F.lit(""))).alias("attribute"), "confidence", F.coalesce(F.length(tail), F.lit(0)).alias("n_tail"), second.alias("second_opinion"))


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_PATTERNS = [(n, _q(cue_pattern(cues, k)), c) for n, cues, k, c in RULES]
_ACT = " ".join(f"WHEN regexp_matches(lower(message), {p}) THEN '{n}'" for n, p, _ in _PATTERNS)
_VALUE = " ".join(f"WHEN regexp_matches(lower(message), {p}) THEN trim(regexp_extract(lower(message), {p}, 1))" for _, p, _ in _PATTERNS)
_SURE = " ".join(f"WHEN regexp_matches(lower(message), {p}) THEN {c}" for _, p, c in _PATTERNS)
_CLASS = " ".join(f"WHEN regexp_matches(coalesce(value, ''), {_q(p)}) THEN '{n}'" for n, p in T.CLASSES)
_RECOGNISED = f"""msg AS (SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS turn, coalesce(text, '') AS message FROM conversations WHERE role = 'user'),
rec AS (SELECT *, CASE {_CLASS} ELSE 'feature' END AS attribute FROM (SELECT session_id, turn, message, CASE {_ACT} ELSE 'ambiguous' END AS act, CASE {_VALUE} END AS value, CASE {_SURE} ELSE 0.35 END::DOUBLE AS confidence FROM msg))"""
RECOGNISE_SQL = f"""WITH {_RECOGNISED} SELECT session_id, turn, act, value, attribute, confidence, CASE WHEN turn = 1 THEN length(trim(regexp_extract(lower(message), {_q(TAIL)}, 1))) ELSE 0 END::INT AS n_tail,
  confidence < 0.8 OR act IN ('ambiguous', 'replace') OR regexp_matches(lower(message), {_q(HARD_CUE)}) OR (turn >= 2 AND act IN ('hard', 'soft')) AS second_opinion FROM rec"""


def message_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every operation that a customer's turn states, one for each cue, each once by attribute, key and polarity: the first of equals
    stays (D5). place counts what is left from 1."""
    low = F.lower("message")

    def stated(k: int, name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)), lambda v, i: F.struct((F.lit(1000 * k) + i).alias("pos"), F.lit(name).alias("act"), F.trim(v).alias("value")))

    found = [stated(k, name, cue_pattern(cues, n)) for k, (name, cues, n, _) in enumerate(RULES) if n]
    x = messages(spark, sf_dir).select("session_id", "turn", F.explode(F.concat(*found)).alias("o")).select("session_id", "turn", "o.*")
    x = x.withColumns({"attribute": T.classify_attribute(F.col("value")), "key": T.constraint_key(F.col("value")), "negative": F.col("act").isin(*NEGATIVE)})
    one = x.groupBy("session_id", "turn", "attribute", "key", "negative").agg(F.min(F.struct("pos", "act", "value")).alias("o"))
    place = F.row_number().over(Window.partitionBy("session_id", "turn").orderBy("o.pos"))  # a turn's operations are few
    return one.select("session_id", "turn", place.alias("place"), "o.act", "attribute", "o.value", "key", "negative")


OPERATIONS_SQL = rf"""WITH {_RECOGNISED}, op AS ({" UNION ALL ".join(f"SELECT session_id, turn, {1000 * k} + generate_subscripts(v, 1) AS pos, '{n}' AS act, trim(unnest(v)) AS value FROM (SELECT session_id, turn, regexp_extract_all(lower(message), {p}, 1) AS v FROM msg)" for k, (n, p, _) in enumerate(_PATTERNS) if RULES[k][2])}),
oc AS (SELECT *, CASE {_CLASS} ELSE 'feature' END AS attribute, lower(trim(regexp_replace(trim(regexp_replace(value, '(?i)^\s*(material|color|size|style|budget|feature)\s*:\s*', ''), ' -;,.'), '\s+', ' ', 'g'))) AS key, act IN {NEGATIVE} AS negative FROM op),
o1 AS (SELECT session_id, turn, attribute, key, negative, min(pos) AS pos, arg_min(act, pos) AS act, arg_min(value, pos) AS value FROM oc GROUP BY ALL)
SELECT session_id, turn, row_number() OVER (PARTITION BY session_id, turn ORDER BY pos) AS place, act, attribute, value, key, negative FROM o1"""

#: Products that a customer was shown last and can still name.
RECENT = 3


def explicit_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the products that a rejecting turn names, those it was shown recently, in the order named, and how many were not (D4). A
    turn names its own product, that of two turns before and the first of the session; shown were the RECENT turns before."""
    w = Window.partitionBy("session_id").orderBy("turn")
    x = operations(spark, sf_dir).withColumn("shown", F.collect_list("asin").over(w.rowsBetween(-RECENT, -1)))
    x = x.withColumn("named", F.array_distinct(F.array_compact(F.array("asin", F.lag("asin", 2).over(w), F.first("asin").over(w)))))
    out = x.filter("act = 'reject'").withColumn("rejected", F.array_intersect("named", "shown"))
    return out.select("session_id", "turn", F.array_join(F.col("rejected").cast("array<string>"), ",").alias("rejected"), (F.size("named") - F.size("rejected")).alias("n_unknown"))


def rewrite_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By conversation, signs that a customer keeps rewording: a run of two ambiguous turns or more, an ambiguous share of 0.4
    or more after three turns, a first turn without a category (A31), and counts of recognition outcomes (A28)."""
    r = recognise_messages(spark, sf_dir).withColumn("vague", (F.col("act") == "ambiguous").cast("int"))
    w = Window.partitionBy("session_id").orderBy("turn")
    r = r.withColumn("run", F.col("turn") - F.sum("vague").over(w))  # constant along a run of ambiguous turns
    runs = r.filter("vague = 1").groupBy("session_id", "run").agg(F.count("*").alias("k")).groupBy("session_id").agg(F.max("k").alias("longest"))
    s = r.groupBy("session_id").agg(
        F.count("*").alias("turns"), F.sum("vague").alias("n_ambiguous"), F.count_if("second_opinion").alias("n_second"),
        F.max(F.when((F.col("turn") == 1) & (F.col("act") != "search"), True).otherwise(False)).alias("no_category_first"),
    )
    x = s.join(runs, "session_id", "left").na.fill(0, ["longest"])
    share = F.round(F.col("n_ambiguous") / F.col("turns"), 6)
    return x.select("session_id", "turns", "n_ambiguous", "n_second", "no_category_first", "longest", share.alias("ambiguous_share"), ((F.col("longest") >= 2) | ((F.col("turns") >= 3) & (share >= 0.4)) | F.col("no_category_first")).alias("suspicious"))


REWRITE_SQL = f"""WITH {_RECOGNISED}, o AS (SELECT session_id, turn, act, (act = 'ambiguous')::INT AS vague, confidence < 0.8 OR act IN ('ambiguous', 'replace') OR regexp_matches(lower(message), {_q(HARD_CUE)}) OR (turn >= 2 AND act IN ('hard', 'soft')) AS second FROM rec),
g AS (SELECT *, turn - sum(vague) OVER (PARTITION BY session_id ORDER BY turn) AS run FROM o), l AS (SELECT session_id, max(k) AS longest FROM (SELECT session_id, run, count(*) AS k FROM g WHERE vague = 1 GROUP BY ALL) GROUP BY 1),
s AS (SELECT session_id, count(*) AS turns, sum(vague)::BIGINT AS n_ambiguous, count(*) FILTER (WHERE second) AS n_second, bool_or(turn = 1 AND act <> 'search') AS no_category_first FROM o GROUP BY 1)
SELECT s.*, coalesce(longest, 0) AS longest, round(n_ambiguous / turns, 6) AS ambiguous_share, coalesce(longest, 0) >= 2 OR (turns >= 3 AND round(n_ambiguous / turns, 6) >= 0.4) OR no_category_first AS suspicious FROM s LEFT JOIN l USING (session_id)"""

#: Attributes that a customer can state, and the columns that hold their values.
ATTRIBUTES = ("brand", "color", "item", "size")


def operations(spark: SparkSession, sf_dir: str, in_tasks: bool = False) -> DataFrame:
    """session_id, turn, act, attribute, value, hard, confidence, asin: one operation a turn. in_tasks: products are spread().

    The first line of an order names the category. Then the highest tax rate overrides, a returned line removes, declines
    an attribute, ends the preferences or rejects what was shown, by its quantity; any other line adds a constraint, hard
    from a quantity of 25."""
    lines, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    j = lines.join(spread(part) if in_tasks else part, lines["l_partkey"] == part["p_partkey"])
    turn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    x = j.withColumn("turn", turn)
    kind = F.pmod("l_suppkey", F.lit(len(ATTRIBUTES)))
    words = F.split(F.lower("p_name"), " ")
    value = F.when(kind == 0, F.lower("p_brand")).when(kind == 1, words[0]).when(kind == 2, F.try_element_at(words, F.lit(2))).otherwise(F.col("p_size").cast("string"))
    back, q = F.col("l_returnflag") == "R", F.col("l_quantity")
    act = (
        F.when(F.col("turn") == 1, "search").when(F.col("l_tax") >= 0.07, "override").when(back & (q < 10), "remove").when(back & (q < 18), "decline")
        .when(back & (q < 20), "no_more").when(back, "reject").otherwise("add")
    )
    first = F.col("turn") == 1
    return x.select(
        F.col("l_orderkey").alias("session_id"), "turn", act.alias("act"), F.when(first, "category").otherwise(F.element_at(F.array(*map(F.lit, ATTRIBUTES)), kind.cast("int") + 1)).alias("attribute"),
        F.when(first, F.lower("p_type")).otherwise(F.coalesce(value, F.lit(""))).alias("value"), (q >= 25).alias("hard"), F.round(0.5 + 5 * F.col("l_discount"), 2).alias("confidence"), F.col("p_partkey").alias("asin"),
    )


_OPS = f"""ops AS (SELECT l_orderkey AS session_id, turn::INT AS turn, CASE WHEN turn = 1 THEN 'search' WHEN l_tax >= 0.07 THEN 'override' WHEN l_returnflag = 'R' AND l_quantity < 10 THEN 'remove' WHEN l_returnflag = 'R' AND l_quantity < 18 THEN 'decline'
    WHEN l_returnflag = 'R' AND l_quantity < 20 THEN 'no_more' WHEN l_returnflag = 'R' THEN 'reject' ELSE 'add' END AS act,
  CASE WHEN turn = 1 THEN 'category' ELSE {list(ATTRIBUTES)}[l_suppkey % {len(ATTRIBUTES)} + 1] END AS attribute,
  CASE WHEN turn = 1 THEN lower(p_type) ELSE coalesce(CASE l_suppkey % {len(ATTRIBUTES)} WHEN 0 THEN lower(p_brand) WHEN 1 THEN string_split(lower(p_name), ' ')[1] WHEN 2 THEN string_split(lower(p_name), ' ')[2] ELSE p_size::VARCHAR END, '') END AS value,
  l_quantity >= 25 AS hard, round(0.5 + 5 * l_discount, 2) AS confidence, p_partkey AS asin
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS turn FROM lineitem JOIN part ON l_partkey = p_partkey))"""

REJECTIONS_SQL = f"""WITH {_OPS}, x AS (SELECT *, list(asin) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN {RECENT} PRECEDING AND 1 PRECEDING) AS shown,
  [asin, lag(asin, 2) OVER (PARTITION BY session_id ORDER BY turn), first(asin) OVER (PARTITION BY session_id ORDER BY turn)] AS n0 FROM ops),
y AS (SELECT session_id, turn, coalesce(shown, []) AS shown, list_filter(n0, lambda a, i: a IS NOT NULL AND list_position(n0, a) = i) AS named FROM x WHERE act = 'reject')
SELECT session_id, turn, array_to_string(list_filter(named, lambda a: list_contains(shown, a)), ',') AS rejected, len(list_filter(named, lambda a: NOT list_contains(shown, a)))::INT AS n_unknown FROM y"""

_CONS = "array<struct<attribute:string,value:string,hard:boolean>>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value evaluated once: Spark copies a column into every place that names it, and within lambdas
    evaluates each copy."""
    return F.transform(F.array(value), then)[0]


def fold(s: Column, o: Column) -> Column:
    """The state after one operation.

    An override demotes what was hard, starts a new version, forgets declined attributes and the end of preferences, and
    clears its attribute; a removal takes the equal key alone; a key that is added again stands if it was at least as hard.
    A search names the category, a decline its attribute, and no_more ends the preferences."""
    same = lambda c: (c["attribute"] == o["attribute"]) & (c["value"] == o["value"])
    none = F.array().cast("array<string>")

    def after(over: Column) -> Column:
        demoted = F.transform(s["cons"], lambda c: F.struct(c["attribute"].alias("attribute"), c["value"].alias("value"), (c["hard"] & ~over).alias("hard")))
        left = F.filter(F.when(over, demoted).otherwise(s["cons"]), lambda c: ~(((o["act"] == "override") & (c["attribute"] == o["attribute"])) | ((o["act"] == "remove") & same(c))))
        new = F.struct(o["attribute"].alias("attribute"), o["value"].alias("value"), (o["hard"] | (o["act"] == "override")).alias("hard"))
        stands = lambda kept, n: F.exists(kept, lambda c: same(c) & (c["hard"] | ~n["hard"]))
        added = let(new, lambda n: let(left, lambda kept: F.when(stands(kept, n), kept).otherwise(F.concat(F.filter(kept, lambda c: ~same(c)), F.array(n)))))
        cons = F.when(o["act"].isin("add", "override"), added).when(o["act"] == "remove", left).otherwise(s["cons"])
        declined = F.when(over, none).when(o["act"] == "decline", F.array_union(s["declined"], F.array(o["attribute"]))).otherwise(s["declined"])
        return F.struct(
            (s["version"] + over.cast("int")).alias("version"), F.when(o["act"] == "search", o["value"]).otherwise(s["category"]).alias("category"), cons.cast(_CONS).alias("cons"),
            declined.alias("declined"), F.when(over, F.lit(False)).otherwise(s["no_more"] | (o["act"] == "no_more")).alias("no_more"),
        )

    return let((o["act"] == "override") & ((F.size(s["cons"]) > 0) | s["category"].isNotNull()), after)


def session_turns(ops: DataFrame) -> DataFrame:
    """session_id, ops (in order), states: the state after each operation. A session's operations are gathered, so sessions are
    to be short."""
    fields = ["turn", "act", "attribute", "value", "hard", "confidence", "asin"]
    per = ops.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("ops"))
    zero = F.struct(F.lit(1).alias("version"), F.lit(None).cast("string").alias("category"), F.array().cast(_CONS).alias("cons"), F.array().cast("array<string>").alias("declined"), F.lit(False).alias("no_more"))
    kind = f"array<struct<version:int,category:string,cons:{_CONS},declined:array<string>,no_more:boolean>>"
    step = lambda a, o: F.array_append(a, let(F.element_at(a, -1), lambda s: fold(s, o)))
    states = F.aggregate("ops", F.array(zero).cast(kind), step, lambda a: F.slice(a, 2, F.size(a)))  # the first is that before all
    return per.select("session_id", "ops", states.alias("states"))


def turn_states(ops: DataFrame) -> DataFrame:
    """Every operation with the state after it."""
    zipped = F.arrays_zip(F.col("ops").alias("o"), F.col("states").alias("s"))
    return session_turns(ops).select("session_id", F.explode(zipped).alias("x")).select("session_id", "x.o.*", "x.s.*")


_SAME = "c.attribute = oa AND c.value = ov"
_STATES = f"""{_OPS}, st AS (
  SELECT session_id, 0 AS turn, '' AS act, '' AS attribute, '' AS value, false AS hard, 0.0::DOUBLE AS confidence, 0::BIGINT AS asin, 1 AS version, NULL::VARCHAR AS category, []::STRUCT(attribute VARCHAR, value VARCHAR, hard BOOLEAN)[] AS cons, []::VARCHAR[] AS declined, false AS no_more
  FROM (SELECT DISTINCT session_id FROM ops)
  UNION ALL
  SELECT session_id, turn, act, oa, ov, oh, confidence, asin, version + over::INT, CASE WHEN act = 'search' THEN ov ELSE category END,
    CASE WHEN act IN ('add', 'override') AND len(list_filter(remaining, lambda c: {_SAME} AND (c.hard OR NOT (oh OR act = 'override')))) = 0
         THEN list_append(list_filter(remaining, lambda c: NOT ({_SAME})), {{'attribute': oa, 'value': ov, 'hard': oh OR act = 'override'}}) ELSE remaining END,
    CASE WHEN over THEN [] WHEN act = 'decline' AND NOT list_contains(declined, oa) THEN list_append(declined, oa) ELSE declined END, CASE WHEN over THEN false ELSE no_more OR act = 'no_more' END
  FROM (SELECT *, list_filter(list_transform(cons, lambda c: {{'attribute': c.attribute, 'value': c.value, 'hard': c.hard AND NOT over}}), lambda c: NOT ((act = 'override' AND c.attribute = oa) OR (act = 'remove' AND {_SAME}))) AS remaining
    FROM (SELECT o.session_id, o.turn, o.act, o.attribute AS oa, o.value AS ov, o.hard AS oh, o.confidence, o.asin, st.version, st.category, st.cons, st.declined, st.no_more, o.act = 'override' AND (len(st.cons) > 0 OR st.category IS NOT NULL) AS over
      FROM st JOIN ops o ON o.session_id = st.session_id AND o.turn = st.turn + 1))),
states AS (SELECT * FROM st WHERE turn > 0)"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_states(operations(spark, sf_dir))


def _listed(cons: Column, hard: bool) -> Column:
    kept = F.filter(cons, lambda c: c["hard"] if hard else ~c["hard"])
    return F.array_join(F.array_sort(F.transform(kept, lambda c: F.concat_ws("=", c["attribute"], c["value"]))), ",")


def _sql_listed(hard: bool) -> str:
    return f"array_to_string(list_sort(list_transform(list_filter(cons, lambda c: {'c.hard' if hard else 'NOT c.hard'}), lambda c: c.attribute || '=' || c.value)), ',')"


def fold_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final state of each session: version, category, hard and soft constraints, declined attributes."""
    s = _states(spark, sf_dir)
    last = s.groupBy("session_id").agg(F.max_by(F.struct("version", "category", "cons", "declined", "no_more"), "turn").alias("s"), F.max("turn").alias("turns"))
    return last.select("session_id", "turns", "s.version", "s.category", _listed(F.col("s.cons"), True).alias("hard"), _listed(F.col("s.cons"), False).alias("soft"), F.array_join(F.array_sort("s.declined"), ",").alias("declined"), "s.no_more")


FOLD_SQL = f"""WITH RECURSIVE {_STATES}, l AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS k FROM states)
SELECT session_id, turn AS turns, version, category, {_sql_listed(True)} AS hard, {_sql_listed(False)} AS soft, array_to_string(list_sort(declined), ',') AS declined, no_more FROM l WHERE k = 1"""



def _counts() -> list[Column]:
    return [F.size(F.filter("cons", lambda c: c["hard"])).alias("n_hard"), F.size(F.filter("cons", lambda c: ~c["hard"])).alias("n_soft")]


_SQL_COUNTS = "len(list_filter(cons, lambda c: c.hard))::INT AS n_hard, len(list_filter(cons, lambda c: NOT c.hard))::INT AS n_soft"


def retrieval_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of each turn's recommendation: probe, exploit or recover by the present state, the buying or browsing track
    with its confidence, and how many results to release (D7, D8, R13, F13). Counts are of the state's distinct
    constraints, so what an override removed counts no more."""
    s = _states(spark, sf_dir).select("session_id", "turn", "act", "version", "category", "no_more", *_counts())
    known = F.col("n_hard") + F.col("n_soft")
    mode = (
        F.when(F.col("act") == "reject", "recover").when((F.col("version") >= 2) & (F.col("n_hard") >= 1), "exploit")
        .when(F.col("no_more") | (F.col("n_hard") >= 2) | (known >= 4), "exploit").otherwise("probe")
    )
    track = F.when((F.col("n_hard") >= 1) & (mode != "recover"), "buying").otherwise("browsing")
    sure = F.when(F.col("n_hard") >= 1, F.least(F.lit(0.95), 0.55 + 0.2 * F.col("n_hard"))).when(known == 0, 0.5).otherwise(0.6)
    release = F.when((F.col("turn") >= 5) | (known >= 4), 10).otherwise(1)
    return s.select("session_id", "turn", "version", "category", "n_hard", "n_soft", mode.alias("mode"), track.alias("track"), F.round(sure, 6).alias("track_confidence"), release.alias("emit_k"))


MODE_SQL = f"""WITH RECURSIVE {_STATES}, c AS (SELECT session_id, turn, act, version, category, no_more, {_SQL_COUNTS} FROM states),
m AS (SELECT *, CASE WHEN act = 'reject' THEN 'recover' WHEN version >= 2 AND n_hard >= 1 OR no_more OR n_hard >= 2 OR n_hard + n_soft >= 4 THEN 'exploit' ELSE 'probe' END AS mode FROM c)
SELECT session_id, turn, version, category, n_hard, n_soft, mode, CASE WHEN n_hard >= 1 AND mode <> 'recover' THEN 'buying' ELSE 'browsing' END AS track,
  round(CASE WHEN n_hard >= 1 THEN least(0.95, 0.55 + 0.2 * n_hard) WHEN n_hard + n_soft = 0 THEN 0.5 ELSE 0.6 END, 6)::DOUBLE AS track_confidence, CASE WHEN turn >= 5 OR n_hard + n_soft >= 4 THEN 10 ELSE 1 END AS emit_k FROM m"""


def _keys(cons: Column) -> Column:
    return F.transform(cons, lambda c: F.concat_ws("=", c["attribute"], c["value"], F.when(c["hard"], "hard").otherwise("soft")))


def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints that each turn added to the state and removed from it, and the attributes that may still be asked about:
    neither constrained nor declined, none after the end of preferences (U3, U4)."""
    s = _states(spark, sf_dir)
    before = F.coalesce(F.lag(_keys(F.col("cons"))).over(Window.partitionBy("session_id").orderBy("turn")), F.array().cast("array<string>"))
    x = s.select("session_id", "turn", _keys(F.col("cons")).alias("now"), before.alias("before"), "declined", "no_more", F.transform("cons", lambda c: c["attribute"]).alias("set"))
    legal = F.array_except(F.array_except(F.array(*map(F.lit, ATTRIBUTES)), "set"), "declined")
    join = lambda a: F.array_join(F.array_sort(a), ",")
    return x.select("session_id", "turn", join(F.array_except("now", "before")).alias("added"), join(F.array_except("before", "now")).alias("removed"), F.when(F.col("no_more"), F.lit("")).otherwise(join(legal)).alias("legal"))


_SQL_KEYS = "list_transform(cons, lambda c: c.attribute || '=' || c.value || '=' || CASE WHEN c.hard THEN 'hard' ELSE 'soft' END)"
CHANGES_SQL = f"""WITH RECURSIVE {_STATES}, k AS (SELECT session_id, turn, declined, no_more, list_transform(cons, lambda c: c.attribute) AS had, {_SQL_KEYS} AS now FROM states),
b AS (SELECT *, coalesce(lag(now) OVER (PARTITION BY session_id ORDER BY turn), []) AS before FROM k)
SELECT session_id, turn, array_to_string(list_sort(list_filter(now, lambda x: NOT list_contains(before, x))), ',') AS added, array_to_string(list_sort(list_filter(before, lambda x: NOT list_contains(now, x))), ',') AS removed,
  CASE WHEN no_more THEN '' ELSE array_to_string(list_sort(list_filter({list(ATTRIBUTES)}, lambda a: NOT list_contains(had, a) AND NOT list_contains(declined, a))), ',') END AS legal FROM b"""

#: Least confidence by act. Fixed values.
LEAST = {"add": 0.65, "override": 0.9, "remove": 0.9, "decline": 0.85, "no_more": 0.95}


def guard(act: Column, confidence: Column, value: Column, key: Column, before: Column) -> tuple[Column, Column]:
    """What becomes of a recognised act, and why (F11): weak additions are softened; weak or ungrounded replacements,
    removals and refusals ask back; before holds the keys of the state so far."""
    low = lambda a: (act == a) & (confidence < LEAST[a])
    reason = (
        F.when(low("add"), "add_confidence_below_threshold")
        .when((act == "reject") & (confidence >= LEAST["add"]), "generic_rejection_soft_demote")
        .when(act == "reject", "generic_rejection_confidence_below_add_threshold")
        .when(low("override"), "replace_confidence_below_threshold").when(low("remove"), "remove_confidence_below_threshold")
        .when((act == "override") & (F.trim(value) == ""), "replace_missing_explicit_evidence")
        .when((act == "remove") & ~F.array_contains(before, key), "remove_target_absent")
        .when(low("decline"), "no_preference_attribute_unclear").when(low("no_more"), "no_more_preferences_confidence_below_threshold")
        .otherwise("guard_passed")
    )
    action = F.when(reason == "add_confidence_below_threshold", "soften").when(reason.isin("guard_passed", "generic_rejection_soft_demote"), "apply").otherwise("clarify")
    return action, reason


def _guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _states(spark, sf_dir)
    keys = F.transform("cons", lambda c: F.concat_ws("=", c["attribute"], c["value"]))
    before = F.coalesce(F.lag(keys).over(Window.partitionBy("session_id").orderBy("turn")), F.array().cast("array<string>"))
    x = s.withColumn("before", before)
    action, reason = guard(F.col("act"), F.col("confidence"), F.col("value"), F.concat_ws("=", "attribute", "value"), F.col("before"))
    return x.withColumn("action", action).withColumn("reason", reason)


def transition_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guard action and reason of every operation, and whether the operation is valid at all."""
    x = _guarded(spark, sf_dir)
    code = F.when(F.col("turn") <= 0, "invalid_turn").when(~F.col("confidence").between(0, 1) | F.isnan("confidence"), "invalid_recognition_confidence").when((F.col("act") == "search") & (T.normalize(F.col("value")) == ""), "invalid_category").when(
        F.col("act").isin("add", "override", "remove") & (T.constraint_key(F.col("value")) == ""), "invalid_constraint_operation"
    )
    return x.select("session_id", "turn", "act", "confidence", "action", "reason", F.coalesce(code, F.lit("valid")).alias("validity"))


_GUARDED = f"""{_STATES}, gb AS (SELECT *, coalesce(lag(list_transform(cons, lambda c: c.attribute || '=' || c.value)) OVER (PARTITION BY session_id ORDER BY turn), []) AS before FROM states),
gr AS (SELECT *, CASE WHEN act = 'add' AND confidence < 0.65 THEN 'add_confidence_below_threshold' WHEN act = 'reject' AND confidence >= 0.65 THEN 'generic_rejection_soft_demote' WHEN act = 'reject' THEN 'generic_rejection_confidence_below_add_threshold'
  WHEN act = 'override' AND confidence < 0.9 THEN 'replace_confidence_below_threshold' WHEN act = 'remove' AND confidence < 0.9 THEN 'remove_confidence_below_threshold' WHEN act = 'override' AND trim(value) = '' THEN 'replace_missing_explicit_evidence'
  WHEN act = 'remove' AND NOT list_contains(before, attribute || '=' || value) THEN 'remove_target_absent' WHEN act = 'decline' AND confidence < 0.85 THEN 'no_preference_attribute_unclear'
  WHEN act = 'no_more' AND confidence < 0.95 THEN 'no_more_preferences_confidence_below_threshold' ELSE 'guard_passed' END AS reason FROM gb),
ga AS (SELECT *, CASE WHEN reason = 'add_confidence_below_threshold' THEN 'soften' WHEN reason IN ('guard_passed', 'generic_rejection_soft_demote') THEN 'apply' ELSE 'clarify' END AS action FROM gr)"""
GUARD_SQL = f"""WITH RECURSIVE {_GUARDED} SELECT session_id, turn, act, confidence, action, reason, CASE WHEN NOT confidence BETWEEN 0 AND 1 THEN 'invalid_recognition_confidence' WHEN act = 'search' AND trim(value, ' -;,.') = '' THEN 'invalid_category'
  WHEN act IN ('add', 'override', 'remove') AND trim(value, ' -;,.') = '' THEN 'invalid_constraint_operation' ELSE 'valid' END AS validity FROM ga"""


def guard_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations by guard action, by reason and by act (A29): three groupings of one pass."""
    x = _guarded(spark, sf_dir).groupBy("action", "reason", "act").agg(F.count("*").alias("k"))  # so the groupings see a few rows
    kinds = F.array(*[F.struct(F.lit(n).alias("kind"), F.col(n).alias("name")) for n in ("action", "reason", "act")])
    return x.select("k", F.explode(kinds).alias("x")).groupBy("x.kind", "x.name").agg(F.sum("k").alias("n"))


GUARD_STATS_SQL = f"""WITH RECURSIVE {_GUARDED} SELECT kind, name, count(*) AS n FROM (SELECT 'action' AS kind, action AS name FROM ga UNION ALL SELECT 'reason', reason FROM ga UNION ALL SELECT 'act', act FROM ga) GROUP BY ALL"""


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _states(spark, sf_dir)
    w = Window.partitionBy("session_id").orderBy("turn")
    same = F.lead("version").over(w) == F.col("version")
    after = F.struct(F.lead("act").over(w).alias("act"), F.lead("confidence").over(w).alias("confidence"))
    x = s.withColumn("gone", F.coalesce(same, F.lit(False))).withColumn("after", F.when(same, after))
    hard = (F.col("after.act") == "reject") & (F.col("after.confidence") >= 0.9)
    soft = (F.col("after.act") == "reject") & (F.col("after.confidence") < 0.9)
    return x.groupBy("session_id", "version", "asin").agg(
        F.array_join(F.array_sort(F.collect_list("turn")), ",").alias("shown_turns"), F.count("*").alias("shown_count"), F.bool_or("gone").alias("eliminated"),
        F.when(F.bool_or(F.coalesce(hard, F.lit(False))), "hard_rejected").when(F.bool_or(F.coalesce(soft, F.lit(False))), "soft_demoted").otherwise("none").alias("feedback"),
    )


def product_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By session, version and shown product: the turns it was shown in, whether a later turn of the same version eliminated
    it, and the feedback (W12). A sure rejection of what was shown is hard and stays, another one only demotes."""
    return _history(spark, sf_dir)


_HISTORY = f"""{_STATES}, hl AS (SELECT *, lead(version) OVER w = version AS same, lead(act) OVER w AS na, lead(confidence) OVER w AS nc FROM states WINDOW w AS (PARTITION BY session_id ORDER BY turn)),
hist AS (SELECT session_id, version, asin, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS shown_turns, count(*) AS shown_count, bool_or(coalesce(same, false)) AS eliminated,
  CASE WHEN bool_or(coalesce(same AND na = 'reject' AND nc >= 0.9, false)) THEN 'hard_rejected' WHEN bool_or(coalesce(same AND na = 'reject' AND nc < 0.9, false)) THEN 'soft_demoted' ELSE 'none' END AS feedback FROM hl GROUP BY ALL)"""
HISTORY_SQL = f"WITH RECURSIVE {_HISTORY} SELECT * FROM hist"


def remaining_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of each session that its last version has neither eliminated nor rejected."""
    x = session_turns(operations(spark, sf_dir)).select("session_id", F.transform("ops", lambda o: o["asin"]).alias("asins"), F.transform("states", lambda s: s["version"]).alias("versions"))
    # a version's turn but the last has one after it, which eliminates its product (as in _history, where feedback comes with that)
    late = F.filter(F.arrays_zip("asins", "versions"), lambda z, i: (z["versions"] == F.element_at("versions", -1)) & (i < F.size("asins") - 1))
    return x.select("session_id", F.explode(F.array_except("asins", F.transform(late, lambda z: z["asins"]))).alias("asin"))


OPEN_SQL = f"""WITH RECURSIVE {_HISTORY}, l AS (SELECT session_id, max(version) AS version FROM states GROUP BY 1), x AS (SELECT session_id, asin FROM hist JOIN l USING (session_id, version) WHERE eliminated OR feedback <> 'none')
SELECT DISTINCT session_id, asin FROM states WHERE (session_id, asin) NOT IN (SELECT (session_id, asin) FROM x)"""

#: Identifiers that a trace must not show.
SECRET = r"(?i)^(?:[\w.+-]+@[\w-]+\.[\w.]+|[0-9][0-9 -]{6,}[0-9]|.*(?:api|token|key)[_-]?[0-9a-z]{8,}.*)$"


def redact(value: Column) -> Column:
    """A value that looks like an address, a long number or a key is replaced."""
    return F.when(value.rlike(SECRET), F.lit("[redacted]")).otherwise(value)


def decision_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a turn without names: hashed session, act, guard, redacted value, sizes of the state and of its change (A33, T33,
    O3, D8). trace_order is the canonical order of an export."""
    x = _guarded(spark, sf_dir)
    keys = F.transform("cons", lambda c: F.concat_ws("=", c["attribute"], c["value"]))
    name = F.sha2(F.concat(F.lit("s:"), F.col("session_id").cast("string")), 256)
    return x.select(
        name.alias("session"), "turn", "act", "action", "reason", redact(F.col("value")).alias("value"), "version", F.size("cons").alias("n_constraints"),
        F.size(F.array_except(keys, "before")).alias("n_added"), F.size(F.array_except("before", keys)).alias("n_removed"), F.size("declined").alias("n_declined"), F.concat_ws(":", name, F.lpad(F.col("turn").cast("string"), 4, "0")).alias("trace_order"),
    )


TRACE_SQL = f"""WITH RECURSIVE {_GUARDED}, k AS (SELECT *, list_transform(cons, lambda c: c.attribute || '=' || c.value) AS keys, sha256('s:' || session_id) AS session FROM ga)
SELECT session, turn, act, action, reason, CASE WHEN regexp_full_match(value, '(?i)(?:[\\w.+-]+@[\\w-]+\\.[\\w.]+|[0-9][0-9 -]{{6,}}[0-9]|.*(?:api|token|key)[_-]?[0-9a-z]{{8,}}.*)') THEN '[redacted]' ELSE value END AS value, version, len(cons)::INT AS n_constraints,
  len(list_filter(keys, lambda x: NOT list_contains(before, x)))::INT AS n_added, len(list_filter(before, lambda x: NOT list_contains(keys, x)))::INT AS n_removed, len(declined)::INT AS n_declined, session || ':' || lpad(turn::VARCHAR, 4, '0') AS trace_order FROM k"""


def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, and the least, largest and mean confidence, by reason and act."""
    x = _guarded(spark, sf_dir).groupBy("reason", "act")
    cents = F.sum(F.round(F.col("confidence") * 100).cast("bigint"))
    return x.agg(F.count("*").alias("n"), F.min("confidence").alias("low"), F.max("confidence").alias("high"), (F.round(cents / F.count("*"), 4)).alias("mean_percent"))


TRACE_SUMMARY_SQL = f"""WITH RECURSIVE {_GUARDED} SELECT reason, act, count(*) AS n, min(confidence) AS low, max(confidence) AS high, round(sum(round(confidence * 100)::BIGINT) / count(*), 4) AS mean_percent FROM ga GROUP BY ALL"""

QUERIES = {
    f.__name__: f
    for f in (recognise_messages, message_operations, explicit_rejections, rewrite_signals, fold_state, retrieval_mode, state_changes, transition_guard, guard_statistics, product_history, remaining_products, decision_trace, trace_summary)
}
SQL = dict(zip(QUERIES, (RECOGNISE_SQL, OPERATIONS_SQL, REJECTIONS_SQL, REWRITE_SQL, FOLD_SQL, MODE_SQL, CHANGES_SQL, GUARD_SQL, GUARD_STATS_SQL, HISTORY_SQL, OPEN_SQL, TRACE_SQL, TRACE_SUMMARY_SQL), strict=True))
