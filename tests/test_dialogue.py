"""Hand-computed cases of the dialogue, ranking, evaluation and output operators."""

import pytest
from pyspark.sql import functions as F

from quern.operators import attributes, dialogue, evaluate, experiments, profile, questions, ranking, retrieval, signals
from quern.sources import sinks

OPS = "session_id int, turn int, act string, attribute string, value string, hard boolean, confidence double, asin int"


def states(spark, *ops):
    rows = [(1, i + 1, *o) for i, o in enumerate(ops)]
    return [r.asDict(recursive=True) for r in dialogue.turn_states(spark.createDataFrame(rows, OPS)).orderBy("turn").collect()]


def test_override_keeps_old_as_soft(spark):
    s = states(
        spark, ("search", "category", "standard", True, 0.9, 1), ("add", "color", "red", True, 0.9, 2), ("add", "size", "7", True, 0.9, 3), ("decline", "brand", "", False, 0.9, 4),
        ("override", "color", "blue", False, 0.95, 5),
    )
    assert s[3]["declined"] == ["brand"] and s[3]["version"] == 1
    assert s[4]["version"] == 2 and s[4]["declined"] == [] and s[4]["category"] == "standard"
    assert {(c["attribute"], c["value"], c["hard"]) for c in s[4]["cons"]} == {("size", "7", False), ("color", "blue", True)}


def test_same_key_keeps_the_harder(spark):
    s = states(spark, ("add", "color", "red", True, 0.9, 1), ("add", "color", "red", False, 0.9, 2), ("add", "size", "7", False, 0.9, 3), ("add", "size", "7", True, 0.9, 4), ("remove", "color", "blue", False, 0.9, 5), ("remove", "color", "red", False, 0.9, 6))
    assert [(c["value"], c["hard"]) for c in s[1]["cons"]] == [("red", True)] and [(c["value"], c["hard"]) for c in s[3]["cons"]] == [("red", True), ("7", True)]
    assert len(s[4]["cons"]) == 2 and [c["value"] for c in s[5]["cons"]] == ["7"]


def test_guard(spark):
    rows = [("add", 0.5, "x", []), ("add", 0.7, "x", []), ("reject", 0.7, "", []), ("reject", 0.2, "", []), ("override", 0.8, "x", []), ("override", 0.95, " ", []), ("remove", 0.95, "x", ["color=x"]), ("remove", 0.95, "x", []), ("decline", 0.8, "x", []), ("no_more", 0.9, "", []), ("search", 0.1, "x", [])]
    df = spark.createDataFrame(rows, "act string, confidence double, value string, before array<string>")
    action, reason = dialogue.guard(F.col("act"), F.col("confidence"), F.col("value"), F.concat(F.lit("color="), F.col("value")), F.col("before"))
    got = [tuple(r) for r in df.select(action, reason).collect()]
    assert [a for a, _ in got] == ["soften", "apply", "apply", "clarify", "clarify", "clarify", "apply", "clarify", "clarify", "clarify", "apply"]
    assert got[5][1] == "replace_missing_explicit_evidence" and got[7][1] == "remove_target_absent"


def test_hits_before_the_override_do_not_count(spark):
    rows = [("a", "intent_override", t, True, t) for t in (1, 2, 4)] + [("b", "buying", 1, True, 3)]
    got = {r["sample_id"]: (r["first_hit_turn"], r["hit_rank"]) for r in evaluate.outcomes(spark.createDataFrame(rows, "sample_id string, scenario_type string, turn int, hit boolean, rank int")).collect()}
    assert got == {"a": (4, 4), "b": (1, 3)}


def test_prior_mixes_a_quarter_of_the_softmax(spark):
    pool = spark.createDataFrame([("p", 1, 0.0), ("p", 2, 1.0), ("q", 3, float("nan")), ("q", 4, 5.0), ("r", 5, None), ("r", 6, 1.0)], "pool_id string, id int, score double")
    p = {r["id"]: r["p"] for r in signals.weights(pool).collect()}
    e = 2.718281828459045
    assert p[2] == pytest.approx(0.25 * e / (1 + e) + 0.75 / 2) and p[1] + p[2] == pytest.approx(1)
    assert p[3] == p[4] == p[5] == p[6] == 0.5


def test_short_passages_are_found(spark):
    docs = spark.createDataFrame([(1, "say hello world now"), (2, "othello"), (3, "a b b"), (4, "x a b b y"), (5, None), (6, "hello big world")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "hello"), (2, "hello world"), (3, "a b b"), (4, "hello big world"), (5, "o"), (6, ""), (7, None)], "item_id int, text string")
    got = {tuple(r) for r in retrieval.verbatim(docs, items).collect()}
    assert got == {(1, 1), (1, 2), (1, 6), (2, 1), (3, 3), (3, 4), (4, 6), (5, 1), (5, 2), (5, 6)}


def test_category_shares_are_substrings(spark):
    wanted = spark.createDataFrame([("q", ["men", "shoe"])], "query_id string, words array<string>")
    cats = spark.createDataFrame([("women shoes",), ("hats",), ("mens",)], "cat string")
    assert [tuple(r) for r in retrieval.category_shares(wanted, cats).collect()] == [("q", "women shoes", 1.0)]


def test_pair_bonus_and_tiers(spark):
    con = lambda a, v, hard: {"attribute": a, "value": v, "hard": hard, "key": v, "tokens": [v]}
    kind = "query_id int, version int, category string, exploit boolean, tags array<string>, cons array<struct<attribute:string,value:string,hard:boolean,key:string,tokens:array<string>>>"
    q = spark.createDataFrame([(1, 1, "gears", False, [], [con("color", "red", True), con("item", "wheel", True)])], kind)
    items = spark.createDataFrame([(10, "gears", "red wheel"), (11, "gears", "red disc"), (12, "gears", "blue disc")], "asin int, cat string, text string").withColumns({"size": F.lit("1"), "store": F.lit("s"), "title": F.col("text"), "popularity": F.lit(0.0), "log_ratings": F.lit(0.0)})
    got = {r["id"]: r for r in ranking.scored(q, items, 10).collect()}
    assert got[10]["pairs"] == 1 and got[11]["pairs"] == 0 and got[11]["coverage"] == 0.5 and got[12]["coverage"] == 0
    assert got[10]["score"] - got[11]["score"] == pytest.approx(0.5 * 0.5 + 0.1 + 1.0)  # half the coverage, the pair, the only product that has both
    tiers = spark.createDataFrame([(n,) for n in (0, 1, 2, 10, 11, 50, 51)], "n int")
    assert [r[0] for r in tiers.select(ranking.tier(F.col("n"))).collect()] == [0.0, 1.0, 0.5, 0.5, 0.2, 0.2, 0.0]


def test_external_order_keeps_the_submitted(spark):
    ranked = spark.createDataFrame([(1, i, i) for i in range(1, 6)], "query_id int, id int, rank int")
    said = spark.createDataFrame([(1, 4, 1), (1, 99, 2), (1, 4, 3), (1, 2, 4)], "query_id int, id int, pos int")
    assert [r["id"] for r in ranking.merge_external(ranked, said, 4).orderBy("rank").collect()] == [4, 2, 1, 3]


def test_budget_and_brand(spark):
    rows = [(10.0, "under $20"), (30.0, "under $20"), (30.0, "at least 20"), (None, "under $20"), (5.0, "whatever"), (45.0, "30-50")]
    assert [r[0] for r in spark.createDataFrame(rows, "p double, w string").select(experiments.budget_met(F.col("p"), F.col("w"))).collect()] == [True, False, True, True, True, True]
    names = spark.createDataFrame([("Brand#12",), (" N/A ",), ("A & B",), ("generic",), (None,)], "b string")
    assert [r[0] for r in names.select(attributes.brand(F.col("b"))).collect()] == ["brand 12", None, "a b", None, None]


def test_ranked_values_over_many_ranges(spark):
    df = spark.createDataFrame([("g", float(i % 97)) for i in range(1000)] + [("h", 5.0)] * 3 + [("h", None)], "g string, v double")
    got = {r["g"]: (r["n"], r["lo"], r["mid"], r["hi"]) for r in profile.ranked_values(df, ["g"], "v", {"lo": lambda n: F.lit(1), "mid": lambda n: F.ceil(0.5 * n), "hi": lambda n: n}).collect()}
    values = sorted(float(i % 97) for i in range(1000))
    assert got == {"g": (1000, 0.0, values[499], 96.0), "h": (3, 5.0, 5.0, 5.0)}


def test_digest_sees_every_row(spark):
    rows = [(i, str(i)) for i in range(50)]
    of = lambda r: attributes.digest(spark.createDataFrame(r, "a int, b string").repartition(3), ["a", "b"]).first()["digest"]
    assert of(rows) == of(rows[::-1]) != of(rows[:-1] + [(49, "x")]) and of(rows) != of(rows + rows[:1])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"red wheel {i}") for i in range(6)], "id int, text string")
    out = f"file://{tmp_path}/report"
    assert len(sinks.write_report({"a": df, "b": df.limit(1)}, out, (f"{tmp_path}/in",))) == 2
    with pytest.raises(Exception, match="already exists"):
        sinks.write_report({"a": df}, out)
    with pytest.raises(ValueError, match="overwrite"):
        sinks.write_report({"a": df}, f"{tmp_path}/in/x", (f"{tmp_path}/in",))
    encode = lambda d: d.select("id", sinks.hashed_embedding(F.col("text")).alias("v"))
    path = f"file://{tmp_path}/vectors"
    assert [sinks.encode_missing(df.limit(4), path, encode), sinks.encode_missing(df, path, encode), sinks.encode_missing(df, path, encode)] == [4, 2, 0]
    assert spark.read.parquet(path).count() == 6
    df.write.parquet(f"{tmp_path}/stream")
    for _ in range(2):
        sinks.append_events(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/stream"), f"{tmp_path}/log", f"{tmp_path}/check").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/log").count() == 6


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fold_names_each_value_once(spark):
    """what a fold names twice it evaluates twice a turn; a question is chosen without gathering the turns again."""
    ops = spark.createDataFrame([(1, 1, "search", "category", "x", True, 0.9, 1)], OPS)
    assert _plan(dialogue.turn_states(ops)).count("= override") <= 12
    t = spark.createDataFrame([(1, 1, "x", 0, [], [], False, 0.9)], "session_id int, turn int, category string, known int, set_attributes array<string>, declined array<string>, no_more boolean, confidence double")
    s = spark.createDataFrame([("__all__", "size", 0.5, 0.5)], "category string, attribute string, gain double, answer_probability double")
    assert "collect_list(struct(turn" not in _plan(questions.decide(t, s))


def test_a_constraint_of_unknown_strength_is_added(spark):
    """As in SQL, where a missing quantity is no reason to leave a constraint out."""
    s = states(spark, ("search", "category", "x", True, 0.9, 1), ("add", "size", "7", True, 0.9, 2), ("add", "color", "red", None, 0.9, 3))
    assert [c["value"] for c in s[2]["cons"]] == ["7", "red"]


def test_questions_follow_what_was_asked(spark):
    """Each question counts from the next turn on, an attribute asked again is no new one, guards come first."""
    schema = "session_id int, turn int, category string, known int, set_attributes array<string>, declined array<string>, no_more boolean, confidence double"
    rows = [(1, n, "x", 0, [], [], False, 0.5) for n in range(1, 5)] + [(2, 1, None, 0, [], [], True, 0.9), (2, 2, "y", 0, [], ["size"], False, 0.5)]
    sig = [("x", "color_word", 0.2, 0.5), ("x", "size", 0.2, 0.5), ("x", "store", 0.1, 0.5), ("__all__", "size", 0.9, 0.9), ("__all__", "store", 0.1, 0.1)]
    got = {(r["session_id"], r["turn"]): (r["reason"], r["asked"]) for r in questions.decide(spark.createDataFrame(rows, schema), spark.createDataFrame(sig, "category string, attribute string, gain double, answer_probability double")).collect()}
    assert [got[1, n][1] for n in range(1, 5)] == ["color_word", "size", "store", None] and got[1, 4][0] == "max_questions"
    assert got[2, 1] == ("no_more_preferences", None) and got[2, 2] == ("highest_ask_utility", "store")


def test_products_left_in_the_last_version(spark):
    """the fold is read once, no table meets another by session."""
    plan = dialogue.remaining_products(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(struct(turn") == 1 and "LeftAnti" not in plan
