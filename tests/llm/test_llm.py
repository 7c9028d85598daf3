"""The corpus operators against brute force, on small fixtures with the awkward cases."""

import hashlib
import io
import json
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quern.llm import decontaminate, mixing, quality, queries, secrets, simhash, substrings, tokens, toxicity, urls, warc
from quern.llm.common import table

DOCS = "doc_id bigint, text string, source string, lang string, score double, rate double, copy_no int, _rk string, n string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeiourstn") for _ in range(r.randint(1, 9))) for _ in range(300)]
    passage = [" ".join(r.choice(vocab) for _ in range(k)) for k in (34, 35, 36, 60, 200)]
    rows = []
    for i in range(n):
        parts = [" ".join(r.choice(vocab) for _ in range(r.randint(0, 60))), *r.sample(passage, r.randint(0, 2))]
        r.shuffle(parts)
        rows.append((i, " \n".join(parts), f"src{r.randint(0, 2)}", "en"))
    rows += [(100, None, "a", "en"), (101, "", None, None), (102, " \n\t", "a", "de"), (103, rows[3][1], "a", "en"), (3, rows[3][1], "src0", "en"), (104, "a", "a", "en"), (105, "A b", "a", "en")]
    rows += [(106, "word " * 400, "b", "en"), (None, "no id here", "b", "en"), (107, passage[4] * 40, "b", "en"), (108, "é\u2003ü ß\x1cx \U0001f600 end", "b", "fr"), (109, "x" * 30000, "b", "en")]
    return [(*row, 0.5, 1.5, 7, "k", "n") for row in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_measures(docs):
    for row in quality.rule_ledger(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        t = row["text"] or ""
        ws = words_of(t)
        grams = Counter(zip(ws, ws[1:], ws[2:]))
        covered = {i + k for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if words_of(x)]
        assert row["n_words"] == len(ws) and row["word_chars"] == sum(map(len, ws)) and row["n_repeat_words"] == len(covered)
        assert row["n_dup_lines"] == len(lines) - len(set(lines))


def test_ledger_policies(spark, empty):
    rows = [(1, "ok " * 10), (2, " ".join(f"w{i}" for i in range(80))), (3, " ".join(f"w{i}%%%" for i in range(80))), (4, None)]
    ledger = quality.rule_ledger(spark.createDataFrame(rows, "doc_id int, text string"))
    kept = {r["doc_id"]: r["kept"] for r in quality.apply_policy(ledger, quality.PRODUCTION).collect()}
    assert kept == {1: False, 2: True, 3: False, 4: False}
    got = {r["rule"]: tuple(r)[1:] for r in quality.ablation(ledger).collect()}
    again = quality.stored_ledger(spark.createDataFrame(rows, "doc_id int, text string"))
    assert sorted_rows(again) == sorted_rows(ledger) and sorted_rows(quality.ablation(again)) == sorted_rows(quality.ablation(ledger))
    assert {(r["rules_version"], r["kept_policy"]) for r in quality.apply_policy(again, quality.PRODUCTION).collect()} == {("rules-1", "web-1")}
    with pytest.raises(Exception, match="is for rules-0"):
        quality.apply_policy(again, quality.Policy("old", ("symbols",), "rules-0")).collect()
    assert got["symbols"] == (1, 1, 2) and got["too_short"] == (2, 1, 2) and got["repeated_trigrams"] == (1, 0, 1)
    assert quality.rule_ledger(empty).count() == 0


def test_substrings_brute(docs, empty):
    rows = [(r["doc_id"], words_of(r["text"])) for r in docs.collect()]
    count = Counter(tuple(ws[i : i + 35]) for _, ws in rows for i in range(len(ws) - 34))
    want = []
    for i, ws in rows:
        gone = {p + k for p in range(len(ws) - 34) if count[tuple(ws[p : p + 35])] > 1 for k in range(35)}
        want.append((i, len(ws), len(gone), " ".join(w for p, w in enumerate(ws) if p not in gone)))
    assert sorted_rows(substrings.remove_repeats(docs)) == sorted(want, key=repr)
    assert substrings.remove_repeats(empty).count() == 0


def test_substrings_dense_anchor(spark):
    r = random.Random(5)
    middle = " ".join(f"m{i}" for i in range(36))
    rows = [(i, " ".join(f"x{i}_{r.randint(0, 999)}" for _ in range(r.randint(5, 40))) + f" {middle} " + " ".join(f"y{i}_{r.randint(0, 999)}" for _ in range(30))) for i in range(150)]
    got = {x["doc_id"]: x["n_removed"] for x in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {i: 36 for i in range(150)}


def test_known_spans_brute(spark, empty):
    rows, refs = corpus(9, 40), [r[1] for r in corpus(9, 5)[:5]] + [None, "", "one two"]
    refs[0] = (refs[0] + " ") * 3
    windows = {tuple(w[i : i + 10]) for w in map(words_of, refs) for i in range(len(w) - 9)}
    reference = spark.createDataFrame([(t,) for t in [*refs, refs[0]]], "text string")
    docs = spark.createDataFrame(rows, DOCS)
    for chars in (10**6, 300):
        got = substrings.remove_known(docs, reference, span=10, shard_chars=chars).collect()
        want = []
        for r in rows:
            w = words_of(r[1])
            gone = {i + k for i in range(len(w) - 9) if tuple(w[i : i + 10]) in windows for k in range(10)}
            want.append((r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and any(x[2] for x in want)
    assert {r["n_removed"] for r in substrings.remove_known(docs, empty).collect()} == {0}


def test_automaton_counts():
    r = random.Random(3)
    for _ in range(200):
        seqs = [[r.randint(0, 2) for _ in range(r.randint(4, 14))] for _ in range(r.randint(1, 4))]
        weights = [r.randint(1, 3) for _ in seqs]
        count = Counter()
        for s, w in zip(seqs, weights):
            for i in range(len(s) - 3):
                count[tuple(s[i : i + 4])] += w
        want = [sum(1 << i for i in range(len(s) - 3) if count[tuple(s[i : i + 4])] > 1) for s in seqs]
        assert substrings.repeated_windows(seqs, weights, 4) == want


def test_decontamination_brute(spark, docs, empty):
    texts = [r["text"] for r in docs.filter("text is not null").limit(20).collect()]
    items = [(i, " ".join(t.split()[3 : 3 + 8 * (i % 5 + 1)])) for i, t in enumerate(texts)] + [(50, None), (51, ""), (52, "a"), (53, "End"), (54, items0(texts))]
    tests = spark.createDataFrame(items, "item_id int, text string")
    want = set()
    for r in docs.collect():
        dw = decontaminate.tokens(r["text"])
        for i, t in items:
            iw = decontaminate.tokens(t)
            s = decontaminate.shingles(iw)
            size = min(5, len(iw))
            have = {" ".join(dw[p : p + size]) for p in range(len(dw) - size + 1)} if size else set()
            if s and 10 * len(s & have) >= 8 * len(s):
                want.add((r["doc_id"], i, len(s & have), len(s)))
    for limit in (decontaminate.BROADCAST_CHARS, 1):
        got = {(r["_id"], r["item_id"], r["n_shared"], r["n_shingles"]) for r in decontaminate.contained_items(docs, tests, broadcast_chars=limit).collect()}
        assert got == want and len(want) > 20
    dirty = {i for i, *_ in want}
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, tests).collect()} == {r["doc_id"] for r in docs.collect()} - dirty
    assert decontaminate.contained_items(empty, tests).count() == 0
    assert decontaminate.decontaminate(docs, tests.limit(0)).count() == docs.count()


def items0(texts):
    """An item of which a fifth of the shingles is broken."""
    w = next(t for t in texts if len(t.split()) > 60).split()[:44]
    w[-4:] = ["zz", "zy", "zx", "zw"]
    return " ".join(w)


def toxic_rows(n=240):
    r = random.Random(2)
    vocab = ["".join(r.choice(["the", "er", "an", "ti", "on", "re", "st", "ble"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    bad = ["idiot", "moron", "worthless", "scumbag"]
    docs, labels = [], []
    for i in range(n):
        ws = [r.choice(vocab) for _ in range(r.randint(20, 80))]
        if toxic := i % 4 == 0:
            for _ in range(r.randint(1, 4)):
                ws[r.randrange(len(ws))] = r.choice(bad)
        docs.append((i, " ".join(ws) + ".", "s", "en", 0.5, 1.5, 7, "k", "n"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity(spark, empty):
    rows, labels = toxic_rows()
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (999, None)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, marks)
    extra = [(500, "you are such an ID-IOT here"), (501, "a wor_thlesss thing and a moroon again moroon"), (502, "the ertion onst"), (503, None), (504, ""), (505, "y" * 5000)]
    more = spark.createDataFrame([(i, t, "s", "en", 0.5, 1.5, 7, "k", "n") for i, t in extra], DOCS)
    out = {r["doc_id"]: r["score"] for r in toxicity.score(docs.union(more), model).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(out[i] >= 0.5) == y for i, y in held]) > 0.95
    assert out[500] >= 0.5 and out[501] >= 0.5 and max(out[502], out[503], out[504], out[505]) < 0.5
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.train(docs, marks.limit(0))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}


def brute_windows(text):
    """Features of the window at each letter of a text of one sentence, by a plain triple loop."""
    low = text.lower()
    at = [(ord(c) - 96, k == 0 or not low[k - 1].isalpha()) for k, c in enumerate(low) if "a" <= c <= "z"]
    out = []
    for begin in range(len(at)):
        got = Counter()
        for i in range(begin, min(begin + toxicity.WIDTH, len(at))):
            for k in range(i + 2, min(i + toxicity.SPAN, len(at))):
                for j in range(i + 1, k):
                    triple, weight = (at[i][0], at[j][0], at[k][0]), toxicity.DECAY ** (k - i - 2)
                    got[triple] += weight
                    if at[i][1]:
                        got["word", *triple] += weight
        out.append(got)
    return out


def test_kernel_is_the_plain_loops():
    r = random.Random(4)
    texts = ["idiot", "an idxiot", "nonono no nonono", "ba-nana banana!", "", *["".join(r.choice("abc de") for _ in range(40)) for _ in range(10)]]
    dot = lambda x, y: sum(v * y[k] for k, v in x.items())
    for a in texts:
        for b in texts:
            x, y = (brute_windows(t)[:1] for t in (a, b))
            assert toxicity.kernel(a, b) == pytest.approx(dot(x[0], y[0]) if x and y else 0, rel=1e-5)
    mark = brute_windows("idiot")[0]
    weights = np.zeros(toxicity.CODES, np.float32)
    for k, v in mark.items():
        word, (a, b, c) = len(k) == 4, k[-3:]
        weights[(32 * word + a) << 10 | b << 5 | c] = v
    for t in texts:
        want = [dot(x, mark) for x in brute_windows(t)]
        assert np.allclose(toxicity.margins(toxicity.stream([t])[0], weights)[: len(want)], want, atol=1e-4)


def test_kernel_tolerates_insertions():
    full = toxicity.kernel("idiot", "idiot")
    assert toxicity.kernel("idiot", "idxiot") > 0.55 * full and toxicity.kernel("moron", "mor0n") > 0.3 * toxicity.kernel("moron", "moron")
    assert toxicity.kernel("idiot", "i d i o t") > 0.8 * full and toxicity.kernel("idiot", "thereon") < 0.1 * full


def test_altered_insults(spark):
    d = "/root/testdata/sf0.01"
    model = toxicity.train(table(spark, d, "documents"), table(spark, d, "labels"))
    around = "It byanthblely anreed hestwh of {} ersh anthly a thble whblewh the erha. Is the erresh, of of lyestion, was and."
    for insult in "idiot clown worthless stupid moron loser trash disgusting pathetic".split():
        h = len(insult) // 2
        shapes = (insult, insult.upper(), insult[:h] + "x" + insult[h:], insult[:2] + "v" + insult[2:], insult[:2] + " " + insult[2:], " ".join(insult), "-".join(insult), insult[:h] + "*" + insult[h:])
        assert all(v >= 0.5 for v in toxicity.score_texts(model, [around.format(x) for x in shapes])), insult
    assert max(toxicity.score_texts(model, [around.format("enher"), "", around * 40])) < 0.5
    long = ("the ertion onst. " * 90_000) + "you moron, worthless idiot"
    assert toxicity.features(model, [long])[0, 0] == pytest.approx(toxicity.features(model, ["you moron, worthless idiot"])[0, 0])


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    out = queries.QUERIES["op4_toxicity"](spark, d).join(table(spark, d, "labels"), "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in out]) > 0.93


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "<p>x</p>"), (2, None, None), (3, "http://b/\r\nX: y", ""), (7, "u", "<p>x</p>"), (5, "u", "<p>x</p>"), (9, "v", "é" * 3_000_000), (None, "w", "<p>x</p>"), (10, "w", "only")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, html string, payload string")
    folder, index = warc.write_bundles(pages, f"file://{tmp_path}/w")
    got = {r["page_id"]: r for r in warc.read_bundles(folder, index).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        r, data = got[None if i is None else str(i)], (html or "").encode()
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == warc.payload_digest(data)
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == max(same) else ("revisit", str(max(same))))
        assert r["payload"] == ((html or "") if r["record_type"] == "response" else "")
    folder, index = warc.write_bundles(pages.limit(0), f"file://{tmp_path}/e")
    assert warc.read_bundles(folder, index).count() == 0


def test_warc_frames():
    out = io.BytesIO()
    writer = warc.BundleWriter(out, 100)
    data = [bytes([65 + i]) * n for i, n in enumerate((30, 60, 20, 500, 1))]
    places = [writer.add(x) for x in data]
    writer.close()
    reader = warc.BundleReader(out, len(out.getvalue()))
    assert [f for f, _ in places] == [0, 0, 1, 2, 3]
    for x, (f, at) in reversed(list(zip(data, places))):
        assert reader.frame(f)[at : at + len(x)] == x
    import zstandard

    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert plain == b"".join(data)  # the seek table is a frame that plain readers skip


def test_urls(spark):
    rows = [(1, "http://A.Example.NET/en/x?q#f"), (2, "https://b.net"), (3, "https://b.net/"), (4, None), (5, "no scheme/"), (6, "x://c.org/fr/1"), (7, "x://example.com/de/"), (8, "x://notexample.com/de/"), (9, "x://?a://b"), (10, "h://good.io/a"), (11, "h://bad.io/a\nb")]
    rows += [(100 + i, f"h://bad.io/{i}") for i in range(60)] + [(200 + i, f"h://good.io/{i}") for i in range(60)] + [(4, None)]
    pages = spark.createDataFrame([(*r, "v") for r in rows], "page_id bigint, url string, verdict string")
    outcomes = spark.createDataFrame([(100 + i, 1) for i in range(58)] + [(200 + i, 0) for i in range(60)] + [(10, None), (777, 1)], "page_id bigint, bad int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages, outcomes).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("b.net", "", None, "allow") and got[3] == ("b.net", "/", "net/", "block")
    assert got[4] == got[5] == ("", "", None, "allow") and got[6][2:] == ("org/fr/", "allow") and got[7][2:] == ("example.com/de/", "block")
    assert got[8][2:] == (None, "allow") and got[9][:2] == ("", "")
    assert got[10][3] == "allow" and got[11] == ("bad.io", "/a\nb", None, "block")
    assert {r["verdict"] for r in urls.judge_urls(pages.filter("page_id in (10, 11)"), outcomes.limit(0)).collect()} == {"allow"}
    assert urls.judge_urls(pages.limit(0), outcomes).count() == 0


def test_url_levels(spark):
    names = ["a.b.co.uk", "b.co.uk", "co.uk", "user:pw@a.b.com:8080", "10.0.0.1", "10.0.0.1:80", "[::1]:80", "x.com.", "localhost", "", "me@x.org"]
    df = spark.createDataFrame([(n,) for n in names], "host string")
    name = urls.name_of(df["host"])
    got = [tuple(r) for r in df.select(urls.domain_of(name), urls.suffix_of(name)).collect()]
    assert got[:4] == [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("b.com", "com")]
    assert got[4] == got[5] == ("10.0.0.1", "10.0.0.1") and got[7] == ("x.com", "com") and got[8:10] == [("localhost", "localhost"), ("", "")]
    assert got[6][0] == got[6][1] and got[10] == ("x.org", "org")


def test_beta_below(spark):
    cases = [(0.3, 0.7), (1.0, 1.0), (2.5, 40.0), (30.0, 12.0), (0.05, 3.0), (400.0, 390.0)]
    df = spark.createDataFrame(cases, "a double, b double")
    x = (np.arange(4_000_000) + 0.5) / 4_000_000
    for (a, b), r in zip(cases, df.select(urls.beta_below(df["a"], df["b"], 0.5)).collect()):
        d = np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x) - max((a - 1) * np.log(x[len(x) // 2]), 0))
        assert r[0] == pytest.approx(d[: len(x) // 2].sum() / d.sum(), abs=0.01)


def test_beta_below_takes_time_in_proportion_to_its_points(spark):
    """The fold makes each point once: ten times the points take about ten times as long, not a hundred times."""
    import time

    df = spark.range(300, numPartitions=1).selectExpr("1.0D + id / 7 as a", "2.0D + id / 11 as b").cache()
    df.count()

    def seconds(points):
        best = 1e9
        for _ in range(2):
            began = time.time()
            df.select(urls.beta_below(df["a"], df["b"], 0.5, points).alias("p")).agg({"p": "sum"}).collect()
            best = min(best, time.time() - began)
        return best

    assert seconds(8000) < 30 * max(seconds(800), 0.05)
    few, many = ([r[0] for r in df.select(urls.beta_below(df["a"], df["b"], 0.5, n)).collect()] for n in (400, 8000))
    assert max(abs(x - y) for x, y in zip(few, many)) < 0.01


def test_mixing_carries_any_column(spark):
    rows = [(i, f"t {i}", "s", i, [0.5], 2, "r", 1.0) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, _pieces int, _cdf array<double>, _count int, _row string, _rate double")
    out = mixing.poisson_replicate(docs)
    assert out.columns == [*docs.columns, "copy_no", "order_key"]
    assert {repr(tuple(r)[:-2]) for r in out.collect()} <= {repr(tuple(r)) for r in docs.collect()} and out.count() > 0


def test_decontamination_ids_of_any_type(spark):
    words = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([("d1", "x " + words), ("d2", "nothing here"), (None, words)], "doc_id string, text string")
    items = spark.createDataFrame([("i-one", words), ("i-two", None)], "item_id string, text string")
    for chars in (10**6, 0):
        got = decontaminate.contained_items(docs, items, broadcast_chars=chars).select("_id", "item_id").collect()
        assert sorted(map(tuple, got), key=repr) == [("d1", "i-one"), (None, "i-one")]


def test_mixing(docs, empty):
    got = mixing.poisson_replicate(docs, weights={"src0": 3.0, "b": 1.0}).collect()
    assert {r["source"] for r in got} <= {"src0", "b", None} and [r["order_key"] for r in got] == sorted(r["order_key"] for r in got)
    counts = Counter((r["doc_id"], r["text"]) for r in got)
    assert all(sorted(r["copy_no"] for r in got if (r["doc_id"], r["text"]) == k) == sorted(list(range(1, n // m + 1)) * m) for k, n in counts.items() for m in [1])
    assert mixing.poisson_replicate(empty).count() == 0 and mixing.poisson_replicate(docs).columns[:2] == ["doc_id", "text"]


def test_mixing_rates(spark):
    rows = [(i, "x" * 10, "a" if i % 10 else "b") for i in range(20000)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = Counter(r["source"] for r in mixing.poisson_replicate(docs, weights={"a": 1.0, "b": 4.0}).select("source").collect())
    assert abs(got["a"] - 4000) < 300 and abs(got["b"] - 16000) < 600


def brute_fingerprint(text):
    b = (text or "").encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(b[i : i + 3]), 42) for i in range(max(1, len(b) - 2))] if b else []
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute_components(codes):
    parent = list(range(len(codes)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(codes))]


def test_simhash_brute(spark, empty):
    rows = corpus(4, 80)
    rows += [(200 + i, rows[i % 7][1].replace(" ", f" w{i} ", 1), *rows[0][2:]) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    codes = [brute_fingerprint(r[1]) for r in rows]
    comp = brute_components(codes)
    first = {}
    for r, c in zip(rows, comp):
        if r[0] is not None:
            first[c] = min(first.get(c, r[0]), r[0])
    want = [(r[0], f"{f:016x}", first.get(c)) for r, f, c in zip(rows, codes, comp)]
    assert sorted_rows(simhash.near_duplicates(docs)) == sorted(want, key=repr)
    assert len(set(comp)) < len(set(codes))
    assert simhash.near_duplicates(empty).count() == 0


def test_local_groups_dense():
    r = np.random.default_rng(0)
    for n, flips in ((1, 0), (2, 1), (400, 2), (3000, 3)):
        base = r.integers(0, 1 << 63, 3, dtype=np.uint64)
        codes = base[r.integers(0, 3, n)]
        for _ in range(flips):
            codes = codes ^ (np.uint64(1) << r.integers(0, 64, n).astype(np.uint64))
        codes = np.unique(codes)
        top = simhash.local_groups(codes)
        if len(codes) <= 500:
            comp = brute_components(codes.tolist())
            assert len({(a, b) for a, b in zip(top.tolist(), comp)}) == len(set(comp)) == len(set(top.tolist()))
        assert all(top[t] == t for t in top)


def test_close_pairs():
    r = np.random.default_rng(2)
    codes = r.integers(0, 1 << 63, 5, dtype=np.uint64)[r.integers(0, 5, 300)]
    for _ in range(9):
        codes = codes ^ (np.uint64(1) << r.integers(0, 64, 300).astype(np.uint64))
    for radius in (0, 3, 12):
        want = {(i, j) for i in range(300) for j in range(i) if int(codes[i] ^ codes[j]).bit_count() <= radius}
        got = [(max(p), min(p)) for a, b in simhash.close_pairs(codes, radius) for p in zip(a.tolist(), b.tolist())]
        assert len(got) == len(set(got)) and set(got) == want


def test_links_find_all(spark):
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 400, dtype=np.uint64)
    codes = [base]
    for _ in range(3):
        codes.append(codes[-1] ^ (np.uint64(1) << r.integers(0, 64, 400).astype(np.uint64)))
    codes = np.unique(np.concatenate([base, codes[-1]]))
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp bigint")
    for dense in (2048, 1):
        old, simhash.DENSE = simhash.DENSE, dense
        labels = {x["node"]: x["label"] for x in simhash.components(simhash.links(df)).collect()}
        simhash.DENSE = old
        comp = brute_components([int(c) for c in codes])
        ours = [labels.get(int(c), int(c)) for c in codes.view(np.int64)]
        assert len(set(zip(ours, comp))) == len(set(ours)) == len(set(comp))


def test_tokens_brute(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    at, want = 0, []
    for r in rows:
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    for planes in ("byte", "bit"):
        folder, index = tokens.write_tokens(docs, planes=planes)
        assert sorted_rows(tokens.read_tokens(folder, index)) == sorted(want, key=repr)
    folder, index = tokens.write_tokens(empty)
    assert tokens.read_tokens(folder, index).count() == 0


def test_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(tokens.default_tokenizer()), tokens.Encoder(tokens.default_tokenizer())
    r = random.Random(0)
    parts = ["a", "it's", "  ", " ", "\n", "\t", "\u00a0", "\u2003", "\x1c", "\x85", "<|endoftext|>", "12", "é", "...", "'", "s", "日本", "\U0001f600", "\u0301", "ok ", "\n\n", "word,", "\r\n", "ª.", "x!?", "\0"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    texts += ["", " ", "\n", "a\n\n\nb", "one, two.\nThree"]
    assert e.encode(pa.array([None, *texts[:3]]).slice(1)).to_pylist() == e.encode(pa.array(texts[:3])).to_pylist()
    assert e.encode(pa.array([None, None], pa.string())).to_pylist() == [b"", b""] and len(e.encode(pa.array([], pa.string()))) == 0
    for text, got in zip(texts, e.encode(pa.array(texts)).to_pylist(), strict=True):
        assert np.frombuffer(got, e.dtype).tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_planes_round_trip():
    r = np.random.default_rng(0)
    for kind in ("byte", "bit"):
        out = io.BytesIO()
        w = tokens.PlaneWriter(out, kind, 64)
        docs = [r.integers(0, 2**32, n, dtype=np.uint32) for n in (0, 1, 63, 64, 65, 1000, 0, 5000)]
        for d in docs:
            w.add(d)
        w.close()
        back = list(tokens.PlaneReader(out, len(out.getvalue())).documents())
        assert len(back) == len(docs) and all((a == b).all() for a, b in zip(back, docs))


def brute_secrets(text):
    text, found = text or "", []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end()))
    for rank, (pattern, least) in enumerate(((r"AKIA[A-Z0-9]+", 16), (r"[0-9a-f]+", 32)), 1):
        found += [(m.start(), rank, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return sorted(found)


def test_secrets_brute(spark, empty):
    r = random.Random(1)
    bits = ["token", "TOKEN", "Api_Key", "apikey", " = ", ":", "=", '"', "'", " ", "abcdef12", "0123456789abcdef" * 2, "AKIA", "ABCDEFGHIJKL", "x", "é", "\U0001f600", "\n", "Aa1" * 9, "secret", "passwd", "Zz9" * 8, "."]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(400)]
    rows = [(i, t, f"o{i % 3}", "en", 0.5, 1.5, 7, "k", "n") for i, t in enumerate([*texts, None, "", "a" * 100000, 'token = "' + "Q1w2" * 10])]
    names = secrets.KINDS
    spans = {}
    for i, t, owner, *_ in rows:  # owned spans: values of wide tokens under one owner and in two repositories at most
        wide = [m for m in re.finditer(r"[A-Za-z0-9_-]{24,}", t or "") if re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0]) and re.search("[0-9]", m[0])]
        value = lambda s: re.match(secrets.ASSIGN.replace("++", "+"), t[s[0] : s[2]])[2] if s[1] == 0 else t[s[0] : s[2]]  # noqa: E731, B023
        spans[i] = [(s[0], s[1], s[2], value(s)) for s in brute_secrets(t)] + [(m.start(), 3, m.end(), m[0]) for m in wide], owner
    owners = {}
    for found, owner in spans.values():
        for *_, v in found:
            owners.setdefault(v, set()).add(owner)
    want = {i: sorted({s[:3] for s in found if s[1] == 3 and len(owners[s[3]]) <= secrets.MAX_OWNERS}) for i, (found, _) in spans.items()}
    got = {x["doc_id"]: [(s["start"], s["rank"], s["end"]) for s in x["owned"]] for x in secrets.scan_secrets(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == want and any(want.values())
    for row in secrets.scan_secrets(spark.createDataFrame(rows, DOCS)).collect():
        assert [(s["start"], s["rank"], s["end"]) for s in row["base"]] == brute_secrets(rows[row["doc_id"]][1]), rows[row["doc_id"]][1]
    assert secrets.scan_secrets(empty).count() == 0 and names[3] == "owned"


def test_secret_ownership(spark):
    live, copied = "Ab1" * 10, "Cd2" * 10
    rows = [(1, f"x {live} y", "a", "en"), (2, f"{live}", "a", "de"), (3, copied, "a", "en"), (4, copied, "b", "en"), (5, "e" * 40, None, None)]
    got = {r["doc_id"]: r for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id int, text string, source string, lang string")).collect()}
    assert [(s["start"], s["end"]) for s in got[1]["owned"]] == [(2, 32)] and len(got[2]["owned"]) == 1 and got[1]["n_copied"] == 0
    assert got[3]["owned"] == [] and got[3]["n_copied"] == 1 and len(got[5]["base"]) == 1


def test_secret_copied_over_repositories_of_one_owner(spark):
    copied, live = "Cd2" * 10, "Ab1" * 10
    rows = [(i, f"x {copied}", "hot", lang) for i, lang in enumerate(("en", "de", "fr", "es", "en"))] + [(9, live, "hot", "en")]
    got = {r["doc_id"]: r for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id int, text string, source string, lang string")).collect()}
    assert all(got[i]["owned"] == [] and got[i]["n_copied"] == 1 for i in range(5))
    assert [tuple(c) for c in got[0]["counts"]] == [(2, 3, 32, 1, 4, 5)]
    assert len(got[9]["owned"]) == 1 and [tuple(c) for c in got[9]["counts"]] == [(0, 3, 30, 1, 1, 1)]


def test_digests(spark, sf_dir):
    for row in queries.QUERIES["op10_secret_ownership"](spark, sf_dir).join(table(spark, sf_dir, "documents"), "doc_id").collect():
        found = brute_secrets(row["text"])
        text = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in found)
        assert row["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (row["n_assign"], row["n_access"], row["n_hex"]) == tuple(sum(f[1] == k for f in found) for k in range(3))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_agrees(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    clean = lambda v: None if v != v else round(v, 6) if isinstance(v, float) else int(v) if isinstance(v, np.integer) else v
    got, want = queries.QUERIES[name](spark, sf_dir), con.sql(queries.SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    key = lambda rows: sorted(json.dumps([clean(v) for v in row], default=str) for row in rows)
    assert key([r[c] for c in names] for r in got.collect()) == key([row[want.columns.index(c)] for c in names] for row in want.fetchall())


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs, seen = table(spark, sf_dir, "documents"), []
    base = docs.columns
    for _name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf_dir).cache()
        seen.append((before, docs))
    texts = {r["doc_id"]: r["text"] for r in seen[1][0].collect()}
    order = sorted(texts)
    comp = five_word_groups([texts[i] for i in order])
    first = {}
    for i, c in zip(order, comp):
        first.setdefault(c, i)
    assert {r["doc_id"] for r in seen[1][1].collect()} == set(first.values())
    items = [decontaminate.shingles(decontaminate.tokens(r["text"])) for r in table(spark, sf_dir, "benchmark").collect()]
    clean = {i for i in first.values() if not any(10 * len(s & decontaminate.shingles(decontaminate.tokens(texts[i]))) >= 8 * len(s) for s in items)}
    assert {r["doc_id"] for r in seen[2][1].collect()} == clean
    assert all(after.columns == base for _, after in seen[:4])
    mixed, last = seen[3][1].collect(), seen[4][1].collect()
    assert {r["doc_id"] for r in mixed} <= clean and Counter(r["doc_id"] for r in last) == Counter(r["doc_id"] for r in mixed)
    assert sum(r["n_tokens"] for r in last) == max(r["start"] + r["n_tokens"] for r in last)
    assert sorted_rows(corpus_pipeline.run(spark, sf_dir)) == sorted((tuple(r) for r in last), key=repr)


def five_words(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def five_word_groups(texts):
    sets, parent = [five_words(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(sets))]


def test_near_copies_brute(spark, empty):
    rows, r = corpus(6, 60), random.Random(3)
    for i in range(60):  # one to nine changed words: similarity from about 0.6 to 0.97
        words = rows[i % 12][1].split(" ") + [f"v{i % 12}-{k}" for k in range(60)]
        for k in r.sample(range(len(words)), r.randint(1, 9)):
            words[k] = f"z{i}-{k}"
        rows.append((300 + i, " ".join(words), *rows[0][2:]))
    rows.append((300, "another text under an id that is taken already", *rows[0][2:]))
    comp = five_word_groups([x[1] for x in rows])
    ids = Counter(min(((x[0] is None, x[0]) for x, d in zip(rows, comp) if d == c), key=lambda p: (p[0], p[1] or 0))[1] for c in set(comp))
    docs = spark.createDataFrame(rows, DOCS)
    assert Counter(x["doc_id"] for x in simhash.one_of_each(docs).collect()) == ids
    assert simhash.one_of_each(empty).count() == 0


@pytest.mark.parametrize("few, part", [(16, 512), (2, 8), (4, 30)])
def test_near_copies_of_a_large_group(spark, monkeypatch, few, part):
    """Exactly the components of all pairs, with and without the base text, whatever the sizes of keys and parts."""
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "PART", part)
    monkeypatch.setattr(simhash, "DENSE", part)
    r, rows = random.Random(8), []
    for base in range(2):
        words = [f"w{base}-{k}" for k in range(150)]
        rows += [(1000 * base, " ".join(words))] * base
        for i in range(1, 70):
            changed = list(words)
            for k in r.sample(range(150), r.randint(1, 5)):
                changed[k] = f"z{i}-{k}"
            rows.append((1000 * base + i, " ".join(changed)))
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(5000 + i, f"{passage} " + " ".join(f"q{i}-{k}" for k in range(r.choice([5, 10, 15, 40])))) for i in range(60)]
    r.shuffle(rows)
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    comp = five_word_groups([t for _, t in rows])
    assert sorted(x["doc_id"] for x in kept) == sorted(min(i for (i, _), d in zip(rows, comp) if d == c) for c in set(comp))


def test_near_copies_of_a_group_of_thousands(spark):
    r, words = random.Random(5), [f"w{k}" for k in range(120)]
    rows = [(4000, " ".join(words))]
    for i in range(4000):
        changed = list(words)
        for k in r.sample(range(120), r.randint(1, 2)):
            changed[k] = f"z{i}-{k}"
        rows.append((i, " ".join(changed)))
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(8)
    assert [x["doc_id"] for x in simhash.one_of_each(docs).collect()] == [0]


def test_spanning_components():
    r = random.Random(2)
    sets = [np.unique(np.array([r.randrange(40) for _ in range(r.randint(1, 30))], np.int64)) for _ in range(200)]
    sets += [np.unique(np.append(s[1:], 100 + k)) for k, s in enumerate(sets[:100])]
    as_sets, top = [set(x.tolist()) for x in sets], list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(as_sets[i] & as_sets[j]) >= 80 * len(as_sets[i] | as_sets[j]):
                old, new = max(top[i], top[j]), min(top[i], top[j])
                top = [new if t == old else t for t in top]
    assert simhash.spanning(sets).tolist() == top


def test_bucket_counts_rule_out_no_link():
    """Sets of many sizes and overlaps: whatever is similar enough stays possible, and most of what isn't goes."""
    r, sets = np.random.default_rng(4), []
    for n in (3, 40, 60, 130, 260, 1000):
        base = r.integers(0, 1 << 64, n, np.uint64)
        for share in (1.0, 0.9, 0.85, 0.7, 0.3):
            k = int(n * share)
            sets.append(np.unique(np.append(base[:k], r.integers(0, 1 << 64, r.integers(0, n - k + 2), np.uint64))))
    counts, sizes = [np.frombuffer(simhash.bucket_counts(s), np.uint8) for s in sets], np.array([len(s) for s in sets])
    similar = np.array([[100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) for b in sets] for a in sets])
    np.fill_diagonal(similar, False)
    possible = simhash.possible_links(sizes, np.arange(len(sets)), counts)
    assert (possible | ~similar.any(axis=1)).all() and not possible.all()
    pairs = [(i, j) for i in range(len(sets)) for j in range(i)]
    batch = pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs]), pa.array([counts[i].tobytes() for i, _ in pairs]), pa.array([counts[j].tobytes() for _, j in pairs])], ["a", "b", "x", "y"])
    kept = next(simhash._may_be_similar([batch]))
    kept = set(zip(kept.column("a").to_pylist(), kept.column("b").to_pylist()))
    assert all((i, j) in kept for i, j in pairs if similar[i, j]) and len(kept) < len(pairs) / 4


def test_copy_shingles_are_distinct_windows():
    texts = ["", None, "a", "A b\tc", "a b c d e", "a b c d e f A B C D E", "a b c d e f", " x  y\nz w v é É "]
    h, bounds = simhash.copy_shingles(pa.array(texts))
    sets = [h[s:e].tolist() for s, e in zip(bounds, bounds[1:])]
    assert [len(x) for x in sets] == [len(five_words(t)) for t in texts] and all(x == sorted(set(x)) for x in sets)
    want = [five_words(t) for t in texts]
    assert all(len(set(a) & set(b)) == len(x & y) for a, x in zip(sets, want) for b, y in zip(sets, want))


def test_pipeline_drops_all_near_copies(spark, sf_dir):
    import corpus_pipeline

    docs, seen = table(spark, sf_dir, "documents"), []
    for _name, stage in corpus_pipeline.STAGES[:3]:
        seen.append(docs)
        docs = stage(spark, docs, sf_dir).cache()
    rows = sorted((x["doc_id"], x["text"]) for x in seen[1].collect())
    kept = {rows[c][0] for c in five_word_groups([t for _, t in rows])}
    assert {x["doc_id"] for x in seen[2].collect()} == kept and seen[2].columns == seen[0].columns
    items = [decontaminate.shingles(decontaminate.tokens(x["text"])) for x in table(spark, sf_dir, "benchmark").collect()]
    texts = {i: decontaminate.shingles(decontaminate.tokens(t)) for i, t in rows}
    assert {x["doc_id"] for x in docs.collect()} == {i for i in kept if not any(10 * len(s & texts[i]) >= 8 * len(s) for s in items)}
