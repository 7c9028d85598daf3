"""Every registered query of the search library against DuckDB, hand-computed cases, streams and the entry point."""

import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quern.functions import text as T
from quern.operators import evaluate, mapping, questions, retrieval, signals
from quern.sources import jsonl
from quern.streaming import state, usage

NAMES = sorted(n for m in entry.MODULES for n in m.QUERIES)
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def clean(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_sql_agrees(spark, sf_dir, duck, name):
    got, want = entry.queries()[name](spark, sf_dir), duck.sql(entry.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    key = lambda rows: sorted(json.dumps([clean(v) for v in r], default=str) for r in rows)
    assert key([r[c] for c in names] for r in got.collect()) == key([r[want.columns.index(c)] for c in names] for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_tokens_and_keys(spark):
    df = spark.createDataFrame([("The RED 50% cotton a shirt", "Material:  Soft   Cotton; ", "under $50"), (None, None, "30-50"), ("", "", "no number")], "a string, b string, c string")
    rows = df.select(T.tokens(F.col("a")).alias("t"), T.constraint_key(F.col("b")).alias("k"), T.price_of(F.col("c")).alias("p")).collect()
    assert rows[0]["t"] == ["red", "50%", "cotton", "shirt"] and rows[0]["k"] == "soft cotton" and rows[0]["p"] == 50
    assert rows[1]["t"] is None and rows[1]["p"] == 50 and rows[2]["t"] == [] and rows[2]["p"] is None


def test_missed_session_is_turn_eleven(spark):
    rows = spark.createDataFrame([("a", "buying", 1, False, 1), ("a", "buying", 2, True, 4), ("a", "buying", 3, True, 1), ("b", "buying", 1, False, 2)], "sample_id string, scenario_type string, turn int, hit boolean, rank int")
    m = {r["scenario"]: r for r in evaluate.metrics(evaluate.outcomes(rows)).collect()}["overall"]
    assert (m["n"], m["hit_rate"], m["mrr"], m["mttc"]) == (2, 0.5, 0.125, 6.5)


def test_pool_signals_split_and_missing(spark):
    pool = spark.createDataFrame([("p", i, 1.0) for i in range(4)], "pool_id string, id int, score double")
    values = spark.createDataFrame([(0, "color", "red"), (1, "color", "red"), (2, "color", "blue"), (3, "color", "blue"), (0, "size", "s")], "id int, attribute string, value string")
    got = {r["attribute"]: r for r in signals.pool_signals(pool, values).collect()}
    assert got["color"]["expected"] == 2 and got["color"]["shrink"] == 0.5 and got["color"]["coverage"] == 1
    assert got["size"]["expected"] == 4 and got["size"]["coverage"] == 0.25  # missing values stay compatible


def test_fusion_adds_routes(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, id int, rank int")
    b = spark.createDataFrame([(1, 11, 1)], "query_id int, id int, rank int")
    got = {r["id"]: (r["rrf"], r["routes"]) for r in retrieval.reciprocal_rank_fusion({"x": a, "y": b}).collect()}
    assert got[11] == (round(1 / 62 + 1 / 61, 6), "x,y") and got[10] == (round(1 / 61, 6), "x")


def test_floor_quantiles(spark):
    from quern.operators.profile import floor_quantiles

    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    assert {r["p"]: r["value"] for r in floor_quantiles(df, "v", (0.25, 0.5)).collect()} == {0.25: 3.0, 0.5: 6.0}


def test_streams(spark, tmp_path):
    rows = [("2024-01-01 00:05:00", "view", 1.0, "s", "m1"), ("2024-01-01 00:15:00", "view", 3.0, "s", "m1"), ("2024-01-01 03:00:00", "view", 9.0, "s", "m2"), ("2024-01-01 03:10:00", "view", 9.0, "s", "m4"), ("2024-01-01 00:01:00", "view", 5.0, "s", "m3")]
    for i, part in enumerate((rows[:3], rows[3:4], rows[4:])):
        spark.createDataFrame(part, "ts string, event_type string, value double, session_id string, message_id string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    schema = "ts timestamp, event_type string, value double, session_id string, message_id string"

    def run(f, name, mode="append"):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")
        q = f(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert [(r["turns"], r["latency"]) for r in run(usage.windowed_usage, "w")] == [(2, 2.0)]  # the late event is dropped
    assert sorted(r["message_id"] for r in run(usage.once_per_message, "o")) == ["m1", "m2", "m3", "m4"]


def test_runs_without_the_corpus_operators(tmp_path):
    import pathlib
    import subprocess
    import sys

    repo = pathlib.Path(entry.__file__).parent
    (tmp_path / "quern").mkdir()
    for p in (repo / "quern").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "quern" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((repo / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_question_spread_by_hand(spark):
    """Four equal candidates: two red, one blue, one without a colour; sizes 1, 2, 2 and none."""
    pool = spark.createDataFrame([("p", i, 0.0) for i in range(4)], "pool_id string, id int, score double")
    wide = spark.createDataFrame([(0, {"color_word": "red", "size": "1"}), (1, {"color_word": "red", "size": "2"}), (2, {"color_word": "blue", "size": "2"})], "id int, vals map<string,string>")
    got = {r["asked"]: r for r in questions.spread_signals(questions.remaining(pool, wide)).collect()}
    # colour: 3, 3, 2, 4 stay; pair: 0 keeps {0, 3}, 1 keeps {1, 3}, 2 keeps {2, 3}, 3 keeps all
    assert got["color_word"]["expected"] == 3 and got["color_word"]["worst"] == 4 and got["color_word"]["coverage"] == 0.75
    assert got["color_word+size"]["expected"] == 2.5 and got["color_word+size"]["resolve3"] == 0.75 and got["color_word+size"]["p90"] == 4
    assert got["store"]["expected"] == 4 and got["store"]["coverage"] == 0
    assert got["store"]["finish_gain"] == pytest.approx(0.5 - 0.2)


def test_sizes_and_requirements(spark):
    texts = ["Size: XL shirt", "fits S/M", "US 8.5 shoe", "waist 32", "size 17 inch", "nothing", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(mapping.text_size(F.col("t"))).collect()] == ["letter", "letter_range", "us_number", "number", None, None, None, None]
    fields = spark.createDataFrame([(t,) for t in ["8", "9 W", "x-large", "12 cm", "9 x 6", None]], "t string")
    assert [r[0] for r in fields.select(mapping.structured_size(F.col("t"))).collect()] == ["number_field", "width_field", "letter_field", None, None, None]
    needs = spark.createDataFrame([({"dense": True},), ({"llm": False},), (None,)], "n map<string,boolean>")
    assert [r[0] for r in needs.select(mapping.requirements_met(F.col("n"), {"dense": False, "llm": False})).collect()] == [False, True, True]
    rows, known = spark.createDataFrame([("a",), ("b",), (None,)], "config_id string"), spark.createDataFrame([("a",)], "config_id string")
    assert sorted(str(r[0]) for r in mapping.unknown_configs(rows, known).collect()) == ["None", "b"]


def test_constraint_hit_by_hand(spark):
    rows = [("size", "11", "red ring", "11", "large", "b"), ("color", "red", "red ring", "11", "large", "b"), ("color", "re", "red ring", "11", "large", "b"), ("size", "99", "red ring", "11", "large", "b"), ("brand", "x", "red ring", None, None, None), ("item", "red moon", "red ring", None, None, None), ("item", None, "x", "1", "y", "b")]
    df = spark.createDataFrame(rows, "a string, v string, title string, size string, category string, store string")
    hit = mapping.constraint_hit(F.col("a"), F.col("v"), {f: F.col(f) for f in ("title", "size", "category", "store")})
    assert [r[0] for r in df.select(hit).collect()] == [1.0, 0.8, 0.0, 0.0, 1.0, 0.25, 0.5]


def test_json_lines(spark, tmp_path):
    lines = ['{"id": "a", "n": 1}', "", "oops", "[1]", '{"n": 2}', '{"id": "b", "n": "x"}', '{"id": "c", "n": null}'] + [json.dumps({"id": f"r{i}", "n": i}) for i in range(3000)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "rows.jsonl").write_text("\n".join(lines) + "\n")
    schema = spark.createDataFrame([], "id string, n long").schema
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # many blocks
    try:
        good, bad = jsonl.read_strict(spark, str(tmp_path / "in"), schema, ("id",))
        assert sorted(r["line"] for r in bad.collect()) == [3, 4, 5, 6]
        assert {(r["line"], r["id"]) for r in good.collect()} == {(1, "a"), (7, "c")} | {(8 + i, f"r{i}") for i in range(3000)}
        pos = [r["id"] for r in jsonl.read_catalog(spark, str(tmp_path / "in"), schema).filter("id like 'r%'").orderBy("row_pos").collect()]
        assert pos == [f"r{i}" for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    import gzip

    with gzip.open(tmp_path / "r.json.gz", "wt") as f:
        f.write("\n".join(lines))
    got = jsonl.read_reviews(spark, str(tmp_path / "r.json.gz"), schema, 4)
    assert got.filter("id like 'r%'").count() == 3000 and got.filter("_corrupt is not null").count() >= 2


def test_session_states_equal_the_batch_fold(spark, sf_dir, tmp_path):
    """Turns in two files, the later ones twice: the stream's last states are those of the batch, repeated turns are stale."""
    from quern.operators import dialogue

    turns = dialogue.operations(spark, sf_dir).select("session_id", "turn", "act", "attribute", "value", "hard", F.timestamp_seconds(60 * F.col("turn")).alias("ts")).filter("session_id % 20 = 1").coalesce(1).cache()
    for rows in (turns.filter("turn <= 3"), turns.filter("turn > 3"), turns.filter("turn between 3 and 5")):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = state.session_states(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    out = spark.read.parquet(str(tmp_path / "out"))
    repeated = turns.filter("turn between 3 and 5").count()
    assert out.filter("not accepted").count() == repeated and out.count() == turns.count() + repeated
    last = out.filter("accepted").groupBy("session_id").agg(F.max_by(F.struct("version", "category", "hard", "soft"), "turn").alias("x"))
    want = {r["session_id"]: (r["version"], r["category"], r["hard"], r["soft"]) for r in dialogue.fold_state(spark, sf_dir).filter("session_id % 20 = 1").collect()}
    assert {r["session_id"]: tuple(r["x"]) for r in last.collect()} == want


def test_pairs_differences_and_retention(spark):
    own = spark.createDataFrame([(1, ["blue", "cotton", "red"]), (2, ["cotton", "red"])], "asin int, keys array<string>")
    assert {(r["first"], r["second"]): (r["n_products"], r["bonus"]) for r in retrieval.count_pairs(own).collect()} == {("blue", "cotton"): (1, 1.0), ("blue", "red"): (1, 1.0), ("cotton", "red"): (2, 0.5)}
    rows = spark.createDataFrame([("a", True, 1, "buying", 1), ("b", True, 7, "buying", 2), ("c", False, None, "buying", 1), ("d", True, 5, "intent_override", 2)], "sample_id string, hit boolean, rank int, scenario_type string, turn int")
    assert {r["sample_id"]: r["y"] for r in evaluate.paired(rows).collect()} == {"a": 0.0, "b": 1.0, "c": 0.0, "d": 0.0}
    days = spark.sql("select 1 as user_id, timestamp_seconds(86400 * id) as ts from range(60)")
    kept = evaluate.latest_sessions(days).collect()
    assert len(kept) == 50 and {r["session_id"]: r["place"] for r in kept}["1-19700301"] == 1


def test_a_field_is_cut_once_for_a_product(spark, sf_dir):
    """pairs of product and constraint are read from one fold, words of fields are cut before products meet constraints."""
    plan = mapping.field_constraint_hits(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(struct(turn") == 1 and plan.count("split(") <= 6
