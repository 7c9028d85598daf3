"""Bounded search, vector cells, two-step questions, mentions, folds, digests and session history against brute force."""

import datetime as dt
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quern.operators import cells, dialogue, experiments, folds, lookahead, mentions, ranking, retrieval, topk
from quern.sources import jsonl
from quern.streaming import history, usage


def test_blocks_leave_most_rows_unscored():
    """Terms as brands, types and colours have them: the best ten are those of a whole scan, few rows are looked at."""
    r, rows = random.Random(3), []
    for i in range(4000):
        terms = {f"brand{r.randrange(25)}": 3.0, f"type{r.randrange(6)}": 1.5, f"word{r.randrange(60)}": 2.5, "all": 1e-6}
        rows += [(i, "|".join(sorted(terms)), t, w * r.choice([0.9, 1.0])) for t, w in terms.items()]
    lists = topk.Lists(pa.table({"id": [x[0] for x in rows], "cluster": [x[1] for x in rows], "term": [x[2] for x in rows], "part": [x[3] for x in rows]}))
    looked = 0
    for _ in range(60):
        asked = [f"brand{r.randrange(26)}", f"type{r.randrange(6)}", f"word{r.randrange(60)}"]
        ids, scores, n = lists.best(asked, None, None, 10)
        sums = Counter()
        for i, _, t, w in rows:
            if t in asked:
                sums[i] += w
        want = sorted(sums.items(), key=lambda x: (-round(x[1], 6), x[0]))[:10]
        assert ids.tolist() == [i for i, _ in want] and np.allclose(scores, [s for _, s in want])
        looked += n
    assert looked < 0.05 * 60 * 4000
    held = {i for i, c, *_ in rows if "brand1|" in c and "type2|" in c}
    assert set(lists.best(["word3"], ["brand1", "type2"], None, 5000)[0].tolist()) == {i for i, _, t, _ in rows if t == "word3" and i in held}
    assert set(lists.best([], ["brand1", "type2"], ["word1", "word2"], 5000)[0].tolist()) == {i for i, _, t, _ in rows if t in ("word1", "word2") and i in held}
    assert lists.best(["nobody"], None, None, 5)[2] == 0 and len(lists.best(["all"], ["nobody"], None, 5)[0]) == 0


def test_equal_rows_are_searched_once(spark):
    """Thousands of rows with the same terms and parts, and some of their own: the best by score and id, from few searched rows."""
    rows = [(i, f"c{i % 3}", t, p) for i in range(3000) for t, p in ((f"t{i % 3}", 1.0), ("all", 0.5 if i != 2999 else 0.75))]
    posted = spark.createDataFrame(rows, "id bigint, cluster string, term string, part double")
    asked = spark.createDataFrame([("a", ["all", "t2"], None, None), ("b", [], ["t1"], None), ("c", ["t0"], ["all"], ["t0", "t9"])], "ask string, terms array<string>, must array<string>, one_of array<string>")
    got = {}
    for x in topk.term_search(posted, asked, 4).orderBy("ask", "rank").collect():
        got.setdefault(x["ask"], []).append((x["id"], x["score"]))
    assert got == {"a": [(2999 if 2999 % 3 == 2 else 2, 1.75 if 2999 % 3 == 2 else 1.5), (2, 1.5), (5, 1.5), (8, 1.5)], "b": [(1, 0.0), (4, 0.0), (7, 0.0), (10, 0.0)], "c": [(0, 1.0), (3, 1.0), (6, 1.0), (9, 1.0)]}


def test_values_held_by_equal_texts_count(spark):
    """Every product counts, though equal texts are tested once and only texts of the category."""
    items = spark.createDataFrame([(f"c{i % 2}", ["red ring 1", "red bolt 12"][i // 2 % 2]) for i in range(80)], "cat string, text string")
    sets = spark.createDataFrame([("c0", ["1", "12"]), ("c0", ["red"]), ("c1", ["ring"]), ("c1", ["zzz"]), ("c2", ["red"])], "category string, vals array<string>")
    assert sorted((x["category"], x["vals"], x["left"]) for x in experiments.holding_all(sets, items).collect()) == [("c0", ["1", "12"], 20), ("c0", ["red"], 40), ("c1", ["ring"], 20)]


def test_words_end_where_ascii_letters_do(spark):
    """An accented letter next to a word is no part of it, as in SQL."""
    df = spark.createDataFrame([("lé the",), ("éthe",), ("thé",), ("nothe",), ("über the_",)], "t string")
    from quern.functions import text as T

    assert [x[0] for x in df.select(F.col("t").rlike(T.ascii_words(r"\bthe\b"))).collect()] == [True, True, False, False, False]
    assert df.select(F.regexp_replace("t", T.ascii_words(r"\bthe\b"), "that").alias("t")).collect()[1]["t"] == "éthat"


def test_states_are_ranked_as_by_a_whole_scan(spark, monkeypatch):
    """Products and states at random; the bounds of blocks leave the same rows as scoring everything."""
    r = random.Random(5)
    names = [f"{a} {b}" for a in ("red", "blue", "old", "new") for b in ("ring", "bolt", "wheel")]
    products = [(i, f"cat{i % 3}", r.choice(names), f"brand {r.randrange(9)}", str(r.randrange(1, 20)), r.random(), r.random() * 3) for i in range(900)]
    table = pa.table({"asin": [p[0] for p in products], "cat": [p[1] for p in products], "title": [p[2] for p in products], "store": [p[3] for p in products], "size": [p[4] for p in products], "popularity": [p[5] for p in products], "log_ratings": [p[6] for p in products], "text": [" ".join((p[2], p[1], p[3], p[4])) for p in products]})
    shelf, looked = ranking.Shelf(table), 0
    for _ in range(40):
        cons = [{"attribute": a, "value": v, "hard": r.random() < 0.5, "key": v, "tokens": v.split()} for a, v in (("color", r.choice(names).split()[0]), ("brand", f"brand {r.randrange(9)}"), ("size", str(r.randrange(10, 20)))) if r.random() < 0.8]
        state = {"category": f"cat{r.randrange(3)}", "cons": cons, "tags": ["ring"], "exploit": r.random() < 0.5, "share": 1.0, "top": 1.03, "match": 1.0, "n_full": r.choice([0, 1, 7, 80])}
        ids, coverage, pairs, score, n = ranking.rank_state(shelf, state, 10)
        looked += n
        with monkeypatch.context() as m:
            m.setattr(ranking, "best_blocks", lambda bound, edges, f, k: ((rows := topk.ranges(edges[:-1][np.isfinite(bound)], edges[1:][np.isfinite(bound)])), f(rows)))
            every = ranking.rank_state(shelf, state, 10)
        assert every[4] == 300 and ids.tolist() == every[0].tolist() and np.array_equal(score, every[3])
        if cons:
            found, value, strict, _ = ranking.filter_state(shelf, state, 10)
            with monkeypatch.context() as m:
                m.setattr(ranking, "best_blocks", lambda bound, edges, f, k: ((rows := topk.ranges(edges[:-1][np.isfinite(bound)], edges[1:][np.isfinite(bound)])), f(rows)))
                assert ranking.filter_state(shelf, state, 10)[0].tolist() == found.tolist()
            assert all(s == (v == 1) for s, v in zip(strict, value))
    assert looked < 40 * 300


def test_states_meet_their_category_outside_the_driver(spark, monkeypatch):
    """Products and states of a category meet in small shards and parts; no row of either is collected."""
    r = random.Random(8)
    items = [(i, f"cat{i % 3}" if i % 50 else None, r.choice(["red ring", "blue bolt"]), f"brand {r.randrange(4)}", str(r.randrange(1, 9)), r.random(), r.random() * 3) for i in range(300)]
    items = spark.createDataFrame([(*p, " ".join((p[2], p[1] or "", p[3], p[4]))) for p in items], "asin bigint, cat string, title string, store string, size string, popularity double, log_ratings double, text string")
    cons = "array<struct<attribute:string,value:string,hard:boolean,key:string,tokens:array<string>>>"
    asked = [(q, f"cat{q % 4}", [("color", c, True, c, [c]), ("brand", b, False, b, b.split())], ["ring"], q % 2 == 0) for q, (c, b) in enumerate((r.choice(["red", "blue"]), f"brand {r.randrange(5)}") for _ in range(40))]
    asked = spark.createDataFrame(asked, f"query_id bigint, category string, cons {cons}, tags array<string>, exploit boolean")
    want = sorted(tuple(x) for x in ranking.scored(asked, items, 5).collect())
    monkeypatch.setattr(ranking, "RACK", 37)
    monkeypatch.setattr(ranking, "STATES", 3)
    got = ranking.scored(asked, items, 5)
    with monkeypatch.context() as m:
        m.setattr(type(asked), "collect", lambda self: pytest.fail("collected"))
        ranking.scored(asked, items, 5)
    assert want and sorted(tuple(x) for x in got.collect()) == want and len({x[0] for x in want}) == 30


def test_filters_look_up_few_products():
    """Thousands of products that tie: the best twenty are those of a whole scan, found by the subsets of what is met."""
    r = random.Random(9)
    rows = [(i, r.choice(["red ring", "blue bolt", "old gear"]), r.choice([None, "brand 1", "brand 12"]), str(r.randrange(1, 40))) for i in r.sample(range(50_000), 20_000)]
    rack, looked = ranking.Rack(np.array([x[0] for x in rows]), {c: pa.array([x[n] for x in rows], pa.string()) for n, c in enumerate(("title", "store", "size"), 1)}), 0
    for _ in range(30):
        cons = [{"attribute": a, "value": v} for a, v in (("color", "red"), ("color", "blue"), ("item", "gear"), ("brand", "brand 1"), ("size", str(r.randrange(1, 50)))) if r.random() < 0.7] or [{"attribute": "size", "value": "7"}]
        ids, score, strict, n = ranking.filter_state(rack, {"category": "x", "cons": cons}, 20)
        looked += n
        field, want = {"size": 3, "brand": 2}, []
        for x in rows:
            met = {a: any(c["value"] in (x[field.get(a, 1)] or "") for c in cons if c["attribute"] == a) for a in {c["attribute"] for c in cons}}
            want.append((-round(1 - sum(0 if ok else ranking.PENALTY.get(a, 0.2) for a, ok in met.items()), 6), x[0], all(met.values())))
        want = sorted(want)[:20]
        assert ids.tolist() == [w[1] for w in want] and strict.tolist() == [w[2] for w in want] and np.allclose(score, [-w[0] for w in want])
    assert looked < 30 * 400


def test_sets_of_keys_are_divided_by_the_rarest(spark):
    items = spark.createDataFrame([(1, "red wheel big"), (2, "red disc"), (3, "blue wheel big")], "asin int, text string")
    sets = spark.createDataFrame([(["red", "wheel"],), (["wheel"],), (["red", "zzz"],), (["ab", "red"],), ([],)], "keys array<string>")
    got = {("+".join(r["keys"]), r["asin"]) for r in ranking.satisfying(sets, items).collect()}
    assert got == {("red+wheel", 1), ("wheel", 1), ("wheel", 3)}


def test_satisfying_counts_of_equal_texts(spark):
    """Equal texts and texts with the same keys are tested once, and every product counts."""
    items = spark.createDataFrame([(i, ["red wheel 1", "red wheel 2", "red disc", "blue wheel"][i % 4]) for i in range(400)], "asin int, text string")
    sets = spark.createDataFrame([(["red", "wheel"],), (["wheel"],), (["red", "zzz"],), (["ab", "red"],), ([],)], "keys array<string>")
    got = {"+".join(x["keys"]): x["n_full"] for x in ranking.count_satisfying(sets, items).collect()}
    assert got == {"red+wheel": 200, "wheel": 300}


def test_nearest_by_cells_is_exact(spark, monkeypatch):
    for name, value in (("PROBES", 1), ("PART", 40), ("ASKED", 16)):
        monkeypatch.setattr(cells, name, value)
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 16))
    v = centers[rng.integers(0, 12, 600)] + 0.25 * rng.normal(size=(600, 16))
    v[100:140] = v[0]  # equal vectors: ties by id
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 16)], "id bigint, v array<double>").select("id", cells.unit(F.col("v")).alias("u"))
    asked = [*range(0, 600, 7), 0]
    queries = rows.join(spark.createDataFrame([(q,) for q in set(asked)], "id bigint"), "id").withColumnRenamed("id", "query_id")
    for others in (False, True):
        got = sorted((r["query_id"], r["rank"], r["id"]) for r in cells.nearest(rows, queries, 8, others).collect())
        sims = np.round(u[sorted(set(asked))] @ u.T, 6)
        want = []
        for q, s in zip(sorted(set(asked)), sims):
            order = [i for i in sorted(range(600), key=lambda i: (-s[i], i)) if not (others and i == q)][:8]
            want += [(q, k + 1, i) for k, i in enumerate(order)]
        assert got == sorted(want)
    assert cells.nearest(rows.limit(0), queries, 3).count() == 0


def test_queries_go_to_parts_not_cells():
    """Directions without any order, as many cells in reach as there are: a query is sent to each part once, in small batches."""
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centers, u = unit(rng.normal(size=(512, 32))), unit(rng.normal(size=(3000, 32)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(u.tolist()), pa.array(np.full(3000, 0.4))], ["query_id", "u", "least"])
    sent = list(cells._choosing(centers, np.full(512, 1.3), np.arange(512) // 128, np.ones(512, np.int64), False)([batch]))
    pairs = [p for b in sent for p in zip(b.column("query_id").to_pylist(), b.column("part").to_pylist())]
    assert max(b.num_rows for b in sent) <= 1024 and len(pairs) == len(set(pairs)) and len(pairs) <= 4 * 3000


def test_dense_ranks_count_what_hard_constraints_leave_out(spark):
    ranked = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2), (1, 12, 0.7, 3), (2, 11, 0.5, 1)], "query_id int, id int, score double, rank int")
    groups = spark.createDataFrame([(1, [["red", "wool"], ["m"]]), (2, [])], "query_id int, groups array<array<string>>")
    items = spark.createDataFrame([(10, "blue wool m"), (11, "red wool m"), (12, "wool in red, m")], "asin int, text string")
    got = {(r["query_id"], r["id"]): (r["rank"], r["weighted"]) for r in cells.hard_filtered(ranked, groups, items).collect()}
    assert got == {(1, 11): (2, round(0.5 * 0.8 / 102, 8)), (1, 12): (3, round(0.5 * 0.7 / 103, 8)), (2, 11): (1, round(0.5 * 0.5 / 101, 8))}


def test_two_steps_follow_candidates(spark):
    """The gain after an answer, by going through targets, branches and candidates one by one; some lack values."""
    r, names = random.Random(6), lookahead.ATTRIBUTES
    people = [{a: r.choice([None, "x", "y", "z"][: r.randint(2, 4)]) for a in names} for _ in range(25)]
    pool = spark.createDataFrame([("p", i, None) for i in range(25)], "pool_id string, id int, score double")
    wide = spark.createDataFrame([(i, {a: v for a, v in x.items() if v}) for i, x in enumerate(people)], "id int, vals map<string,string>")
    fits = lambda a, x, y: x[a] is None or y[a] is None or x[a] == y[a]

    def gain(rows, a):
        left = sorted(sum(fits(a, x, y) for y in rows) for x in rows)
        n, share = len(rows), lambda k: sum(v <= k for v in left) / len(left)
        expected, p90 = sum(left) / n, next(v for k, v in enumerate(left) if round((k + 1) / n, 9) >= 0.9)
        progress = 0 if n <= 10 else 1 - math.log1p(max(expected - 10, 0)) / math.log1p(n - 10)
        return 0.5 * share(10) + 0.2 * share(3) + 0.1 * share(1) + 0.3 * progress - 0.2 * p90 / n

    got = {x["asked"]: x["two_step"] for x in lookahead.two_steps(pool, wide).collect()}
    for a in names:
        total = sum(max(gain([y for y in people if fits(a, x, y)], b) for b in names if b != a) / 25 for x in people)
        assert got[a] == pytest.approx(max(0, total - lookahead.TURN_COST), abs=2e-6)


def test_pools_are_nested(spark):
    pools = lookahead.nested_pools(spark.range(50), (10, 20, 100), 2).collect()
    of = lambda s, n, k: {x["id"] for x in pools if (x["sample"], x["size"], x["kept"]) == (s, n, k)}
    for s in (0, 1):
        assert of(s, 10, "all") < of(s, 20, "all") < of(s, 100, "all") == set(range(50))
        assert [len(of(s, n, "deleted")) for n in (10, 20, 100)] == [9, 18, 45] and of(s, 20, "deleted") < of(s, 20, "all")
    assert of(0, 10, "all") != of(1, 10, "all")


def test_every_mention_counts(spark):
    texts = spark.createDataFrame([("Red wool, red wool! Not a red wool size 7",), ("no one here wants the redwool; RED\nwool",), (None,), ("",), ("wool wool wool",)], "text string")
    phrases = spark.createDataFrame([("red wool",), ("wool",), ("wool wool",), ("wool",), ("absent",), ("",)], "phrase string")
    got = {r["phrase"]: tuple(r)[1:] for r in mentions.mentions(texts, phrases).collect()}
    assert got == {"red wool": (4, 1, 1, 2), "wool": (7, 1, 1, 3), "wool wool": (2, 0, 0, 1)}
    monkey = pytest.MonkeyPatch()
    monkey.setattr(mentions, "PHRASES", 1)  # in blocks
    assert {r["phrase"]: tuple(r)[1:] for r in mentions.mentions(texts, phrases).collect()} == got
    monkey.undo()


def test_folds_are_balanced_and_whole(spark):
    r = random.Random(4)
    rows = [(t, f"s{r.randrange(3)}") for t in range(300) for _ in range(r.choice([1, 1, 1, 2, 5, 40]))]
    got = folds.deal_groups(spark.createDataFrame(rows, "target int, stratum string")).collect()
    sizes = Counter(t for t, _ in rows)
    assert {x["target"]: x["n"] for x in got} == sizes and len(got) == 300
    by = Counter()
    for x in got:
        by[x["fold"]] += x["n"]
    assert set(by) == set(range(folds.FOLDS)) and max(by.values()) - min(by.values()) <= max(sizes.values())
    few = folds.deal_groups(spark.createDataFrame([(1, "a"), (1, None), (2, None)], "target int, stratum string")).collect()
    assert sorted((x["target"], x["n"], x["fold"]) for x in few) == [(1, 2, 0), (2, 1, 1)]


def test_ranks_without_one_sort(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(500)], "t int, g int")
    got = folds.global_rank(rows, [-F.col("g")], F.col("t")).orderBy("place").collect()
    assert [x["place"] for x in got] == list(range(500)) and [x["g"] for x in got] == sorted((x["g"] for x in got), reverse=True)


def test_digests_name_the_changed_ranges(spark):
    rows = [(i, f"v{i}") for i in range(300)]
    digests = lambda rs: folds.key_digests(spark.createDataFrame(rs, "k int, v string").repartition(3), "k")
    own = digests(rows).cache()
    assert folds.changed_ranges(own, digests(rows[::-1])).count() == 0
    other = folds.changed_ranges(digests([(7, "new"), *[x for x in rows if x[0] not in (7, 9)], (400, None)]), own).collect()
    leaf = lambda k: __import__("hashlib").md5(str(k).encode()).hexdigest()
    assert {x["range"] for x in other if x["level"] == folds.LEAF} == {leaf(k)[: folds.LEAF] for k in (7, 9, 400)}
    assert {x["range"] for x in other if x["level"] == folds.NODE} == {leaf(k)[: folds.NODE] for k in (7, 9, 400)} and [x["n"] for x in other if x["level"] == 0] == [300]
    assert folds.changed_ranges(digests([*rows, rows[0], rows[0]]), own).filter("level = 0").count() == 1  # pairs that cancel are counted


def test_recognition_of_every_act(spark):
    said = {"replace": "rather from old stock, please", "no_more": "well, that is.", "no_preference": "I have no wool", "hard": "only with red wool in it", "soft": "perhaps for winter walks", "reject": "not in question: this ring", "search": "to old rings", "ambiguous": "mmh"}
    rows = spark.createDataFrame(list(said.items()), "want string, message string")
    act, value, sure = dialogue.recognise(F.col("message"))
    got = {r["want"]: (r["act"], r["value"], r["sure"]) for r in rows.select("want", act.alias("act"), value.alias("value"), sure.alias("sure")).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: k for k in said}
    assert got["replace"][1] == "old stock" and got["no_preference"][1] == "wool" and got["hard"][1] == "red wool" and got["search"][1] == "old rings" and got["ambiguous"][1] is None


def test_history_stream_equals_batch(spark, tmp_path):
    r, rows, t0 = random.Random(3), [], dt.datetime(2026, 1, 1)
    for session in range(2):
        for turn in range(1, 40):
            kind = r.choice(["show", "show", "reject", "operation", "request", "override"])
            rows.append((session, turn, kind, [r.randrange(30) for _ in range(r.randint(0, 4))] if kind in ("show", "reject") else None, f"k{r.randrange(8)}" if kind in ("operation", "request") else None, t0 + dt.timedelta(minutes=turn)))
    events = spark.createDataFrame(rows, history.EVENT)
    for low, high in ((0, 20), (20, 99)):
        events.filter((F.col("turn") > low) & (F.col("turn") <= high)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    settings = {"spark.sql.streaming.stateStore.providerClass": history.PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.shuffle.partitions": "1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = history.session_history(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    key = lambda df: sorted((tuple(x) for x in df.collect()), key=repr)
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(history.session_history_batch(events))


def test_history_is_bounded():
    shown, stated, answers = [], {}, {}
    for turn in range(300):
        history.step(shown, stated, answers, turn, "show", [turn, turn + 1], None)
        history.step(shown, stated, answers, turn, "request", [], f"q{turn}")
    assert len(shown) == history.RECENT and len(answers) == history.ANSWERS and "q299" in answers and "q0" not in answers
    assert history.step(shown, stated, answers, 301, "request", [], "q299") == ("", False, "q299@299")
    assert history.step(shown, stated, answers, 302, "reject", [300, 5, 300], None) == ("300", True, None) and 300 not in shown
    assert [history.step(shown, stated, answers, 303, "operation", [], "a=b")[1] for _ in range(2)] == [True, False]
    history.step(shown, stated, answers, 304, "override", [], None)
    assert history.step(shown, stated, answers, 305, "operation", [], "a=b")[1]


def test_sketches_merge_within_their_error(spark):
    r, t0 = random.Random(9), dt.datetime(2026, 1, 1)
    rows = [(r.choice(["view", "purchase"]), t0 + dt.timedelta(minutes=r.randrange(3000)), r.choice([-5, 0, 10, 300, None]), r.lognormvariate(3, 1)) for _ in range(20_000)]
    windows = usage.usage_sketches(spark.createDataFrame(rows, "provider string, ts timestamp, tokens int, latency_ms double"))
    got = {x["provider"]: x for x in usage.quantiles(windows, ["provider"], {"p50": 0.5, "p95": 0.95}).collect()}
    for name in ("view", "purchase"):
        own = sorted(x[3] for x in rows if x[0] == name)
        assert got[name]["n"] == len(own)
        for q, p in (("p50", 0.5), ("p95", 0.95)):
            assert abs(np.searchsorted(own, got[name][q]) / len(own) - p) < 0.01
    assert windows.agg(F.sum("tokens")).first()[0] == sum(max(0, x[2] or 0) for x in rows)


def test_strict_reading_names_the_first_reject(spark, tmp_path):
    schema = StructType([StructField("id", StringType())])
    for name, lines in (("good", ['{"id": "a"}', "", '{"id": "b"}']), ("bad", ['{"id": "a"}', "", "[1]", "nothing"]), ("empty", ["", " "])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "rows.jsonl").write_text("\n".join(lines) + "\n")
    assert jsonl.read_strict(spark, str(tmp_path / "good"), schema, ("id",), strict=True)[0].count() == 2
    with pytest.raises(ValueError, match=r"rows.jsonl:3: .*\[1\]"):
        jsonl.read_strict(spark, str(tmp_path / "bad"), schema, ("id",), strict=True)
    with pytest.raises(ValueError, match="no rows"):
        jsonl.read_strict(spark, str(tmp_path / "empty"), schema, ("id",), strict=True)


def test_top_k_is_used_from_retrieval(spark):
    df = spark.createDataFrame([(1, 5, 1.0), (1, 4, 1.0), (1, 3, 0.5)], "query_id int, id int, score double")
    assert [r["id"] for r in retrieval.top_k(df, 2).orderBy("rank").collect()] == [4, 5]


def test_nested_pools_sort_only_what_may_be_first(spark):
    """the first rows of each sample's order, and no sort of all rows of all samples."""
    import hashlib
    import re

    pools = lookahead.nested_pools(spark.range(30000), (10, 20), 2)
    plan = pools._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"head#\d+ <= last#\d+", plan)
    got = {(r["sample"], r["id"]) for r in pools.filter("size = 20 and kept = 'all'").collect()}
    want = {(s, i) for s in range(2) for i in sorted(range(30000), key=lambda i: hashlib.md5(f"pool:{s}:{i}".encode()).hexdigest())[:20]}
    assert got == want


def test_what_grows_is_not_broadcast(spark, sf_dir, monkeypatch):
    """products, customers, texts, key lists and ranked rows are joined in tasks, however small their files are."""
    r = random.Random(4)
    cons = "array<struct<attribute:string,value:string,hard:boolean,key:string,tokens:array<string>>>"
    asked = spark.createDataFrame([(q, "c0", [("color", r.choice(["red", "blue"]), True, "red", ["red"])], ["ring"], True) for q in range(9)], f"query_id bigint, category string, cons {cons}, tags array<string>, exploit boolean")
    items = spark.createDataFrame([(1, "c0", "red ring", "b", "1", 0.5, 1.0, "red ring c0 b 1")], "asin bigint, cat string, title string, store string, size string, popularity double, log_ratings double, text string")
    monkeypatch.setattr(ranking, "stored", lambda df, tag: df)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    first, all_of = plan(ranking.wanted(spark, sf_dir)), plan(ranking.scored(asked, items, 5))
    assert "ShuffledHashJoin [l_partkey#" in first and "ShuffledHashJoin [o_custkey#" in first
    assert all(f"ShuffledHashJoin [{k}#" in all_of for k in ("g", "key", "state")) and "BroadcastHashJoin [g#" not in all_of


def test_pools_count_every_session(spark, sf_dir):
    """an attribute's queries are all sessions whose last state constrains it, whatever their key."""
    from quern.operators.dialogue import fold_state

    states = [[c.split("=")[0] for c in f"{x['hard']},{x['soft']}".split(",") if c] for x in fold_state(spark, sf_dir).collect()]
    assert {x["attribute"]: x["n"] for x in experiments.attribute_pools(spark, sf_dir).collect()} == Counter(a for s in states for a in set(s))


def test_every_session_has_its_count(spark, sf_dir):
    """the products that satisfy a session's last state are counted for all sessions, whatever their key."""
    from quern.operators.dialogue import fold_state

    got = {x["query_id"]: (x["n_constraints"], x["n_products"]) for x in ranking.satisfying_products(spark, sf_dir).collect()}
    texts = [x["text"] for x in ranking.products(spark, sf_dir).select("text").collect()]
    want = {}
    for x in fold_state(spark, sf_dir).collect():
        values = [c.split("=", 1)[1] for c in f"{x['hard']},{x['soft']}".split(",") if c]
        want[x["session_id"]] = len(values), sum(all(3 <= len(v) <= 180 and v in t for v in values) for t in texts) if values else 0
    assert got == want and any(q % 50 and n for q, (_, n) in got.items())


def test_every_session_has_its_pool(spark, sf_dir):
    """pools are made for all sessions, whatever their key; sessions that ask the same get the same one."""
    sessions = {x[0] for x in dialogue.fold_state(spark, sf_dir).select("session_id").collect()}
    pools = {x["query_id"]: x["n"] for x in ranking.recall_pool(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    assert set(pools) == sessions and len(sessions) > 1000 and max(pools.values()) == 2 * ranking.TOP


def test_lists_of_shards_are_merged(spark, monkeypatch):
    """Rows in many shards, each standing for several: the best by rounded score and id, with a mandatory term and without."""
    r, rows = random.Random(6), []
    for i in range(600):
        rows += [(i, f"c{i % 7}", t, p) for t, p in ((f"t{r.randrange(5)}", r.choice([0.5, 1.0])), (f"u{r.randrange(4)}", r.choice([0.25, 1.0])), ("all", 0.125))]
    posted = spark.createDataFrame(rows, "id bigint, cluster string, term string, part double")
    asked = [("a", ["all", "t2", "u1"], None, None), ("b", ["u3", "t1"], ["t1"], None), ("c", ["t0"], ["all"], ["t0", "u2"]), ("d", ["zzz"], None, None)]
    monkeypatch.setattr(topk, "SHARD", 1)
    monkeypatch.setattr(topk, "FEW", 1)
    found = topk.term_lists(posted, spark.createDataFrame(asked, "ask string, terms array<string>, must array<string>, one_of array<string>"), 9)
    got = {x["ask"]: [(h["id"], h["score"]) for h in x["hits"]] for x in found.collect()}
    held = {}
    for i, _, t, p in rows:
        held.setdefault(i, {})[t] = p
    for ask, terms, must, one_of in asked:
        fit = [(-sum(h.get(t, 0) for t in terms), i) for i, h in held.items() if all(t in h for t in must or ()) and (one_of is None or any(t in h for t in one_of))]
        assert got.get(ask, []) == [(i, -s) for s, i in sorted(fit) if s < 0][:9]
