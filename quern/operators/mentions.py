"""Every mention of many phrases in texts, in one pass, with what negates or sizes it nearby.

All phrases are one Aho-Corasick automaton over words, so that hundreds of them cost what one does. A task walks each text once,
looks at the words around every hit and adds up by phrase before anything is shuffled. Up to PHRASES phrases go to
the tasks at once; more are asked in blocks chosen by hash."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.staging import stored
from quern.sources.views import read

PHRASES, AROUND = 200_000, 4
#: Words that negate a mention up to AROUND words before it, and that size one up to AROUND words on either side.
NEGATIONS = ("not", "no", "never", "without", "nicht", "kein", "pas", "sin")
SIZES = ("size", "small", "large")
#: Anchor words by label.
ANCHORS = (("licence", "license"), ("licence", "copyright"), ("contact", "mail"), ("contact", "phone"), ("function", "of the"), ("function", "der"), ("secret", "password"), ("secret", "token"))
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of letters and digits, A to Z lower-cased."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(f"({WORD})"), 1)


def _walking(phrases: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        if not phrases:
            return
        machine = ahocorasick.Automaton()
        for n, p in enumerate(phrases):
            machine.add_word(f" {p} ", n)
        machine.make_automaton()
        lengths = [p.count(" ") + 1 for p in phrases]
        fold, find = str.maketrans(_UPPER, _LOWER), re.compile(WORD).findall
        for batch in batches:
            sums: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                own = find(text.translate(fold))
                line = f" {' '.join(own)} "
                places = {}  # of the blank after a word: the number of the word
                at = 0
                for k, w in enumerate(own):
                    at += len(w) + 1
                    places[at] = k
                seen = set()
                for end, n in machine.iter(line) if own else ():
                    last = places[end]
                    first = last - lengths[n] + 1
                    before, after = own[max(0, first - AROUND) : first], own[last + 1 : last + 1 + AROUND]
                    s = sums[n]
                    s[0] += 1
                    s[1] += any(w in NEGATIONS for w in before)
                    s[2] += any(w in SIZES or (w.isascii() and w.isdigit()) for w in (*before, *after))
                    s[3] += n not in seen
                    seen.add(n)
            cols = list(zip(*[(phrases[n], *s) for n, s in sums.items()], strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]], ["phrase", "n", "n_negated", "n_sized", "n_texts"])

    return run


def mentions(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrase, n, n_negated, n_sized, n_texts: all mentions of each phrase (words joined by one blank) in texts (column text),
    overlapping ones too. Null and empty texts have none; a phrase without mentions has no row."""
    listed = stored(phrases.select("phrase").filter("length(phrase) > 0").distinct(), "phrases")
    blocks = max(1, -(-listed.count() // PHRASES))
    out = None
    for b in range(blocks):
        some = [r["phrase"] for r in listed.filter(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == b).collect()]  # about PHRASES
        part = texts.select("text").mapInArrow(_walking(some), "phrase string, n bigint, n_negated bigint, n_sized bigint, n_texts bigint")
        out = part if out is None else out.union(part)
    return out.groupBy("phrase").agg(*[F.sum(c).alias(c) for c in ("n", "n_negated", "n_sized", "n_texts")])


def intent_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """intent, phrase: the pairs of neighbouring words of each benchmark passage."""
    w = words(F.col("text"))
    pairs = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))
    return read(spark, sf_dir, "benchmark").filter("text is not null").select(F.col("item_id").alias("intent"), F.explode(F.array_distinct(pairs)).alias("phrase"))


def phrase_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents by phrases: mentions in all documents, texts that have one, and the share that is negated."""
    asked = stored(intent_phrases(spark, sf_dir), "intent-phrases")
    found = mentions(read(spark, sf_dir, "documents"), asked)
    out = asked.join(found, "phrase", "left").na.fill(0, ["n", "n_negated", "n_texts"])
    return out.select("intent", "phrase", "n", "n_texts", F.round(F.col("n_negated") / F.nullif("n", F.lit(0)), 6).alias("negation_rate"))


def anchor_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By label and anchor: every mention in all documents, and the rates of those negated and sized nearby."""
    anchors = spark.createDataFrame(ANCHORS, "label string, phrase string")
    found = mentions(read(spark, sf_dir, "documents"), anchors)
    rate = lambda c: F.round(F.col(c) / F.col("n"), 6)
    return F.broadcast(anchors).join(found, "phrase").select("label", F.col("phrase").alias("anchor"), "n", "n_texts", rate("n_negated").alias("negation_rate"), rate("n_sized").alias("size_rate"))  # a settings list


_SPLIT = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{WORD}')"
_FOUND = f"""d AS (SELECT row_number() OVER () AS row, {_SPLIT} AS ws FROM documents WHERE text IS NOT NULL),
u AS (SELECT row, generate_subscripts(ws, 1) AS i, unnest(ws) AS w, ws FROM d),
ph AS (SELECT DISTINCT phrase, string_split(phrase, ' ') AS ps FROM asked),
f AS (SELECT phrase, row, ws[greatest(1, i - {AROUND}):i - 1] AS before, ws[i + len(ps):i + len(ps) + {AROUND - 1}] AS after FROM u JOIN ph ON w = ps[1] WHERE ws[i:i + len(ps) - 1] = ps),
m AS (SELECT phrase, count(*) AS n, count(DISTINCT row) AS n_texts, count(*) FILTER (WHERE list_has_any(before, {list(NEGATIONS)})) AS n_negated,
  count(*) FILTER (WHERE len(list_filter(list_concat(before, after), lambda x: list_contains({list(SIZES)}, x) OR regexp_full_match(x, '[0-9]+'))) > 0) AS n_sized FROM f GROUP BY 1)"""
MENTIONS_SQL = f"""WITH asked AS (SELECT DISTINCT item_id AS intent, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS phrase FROM (SELECT item_id, {_SPLIT} AS ws FROM benchmark WHERE text IS NOT NULL)), {_FOUND}
SELECT intent, phrase, coalesce(n, 0) AS n, coalesce(n_texts, 0) AS n_texts, round(n_negated / n, 6) AS negation_rate FROM asked LEFT JOIN m USING (phrase)"""
ANCHOR_RATES_SQL = f"""WITH asked(label, phrase) AS (VALUES {", ".join(f"('{a}', '{p}')" for a, p in ANCHORS)}), {_FOUND}
SELECT label, phrase AS anchor, n, n_texts, round(n_negated / n, 6) AS negation_rate, round(n_sized / n, 6) AS size_rate FROM asked JOIN m USING (phrase)"""

QUERIES = {f.__name__: f for f in (phrase_mentions, anchor_rates)}
SQL = dict(zip(QUERIES, (MENTIONS_SQL, ANCHOR_RATES_SQL), strict=True))
