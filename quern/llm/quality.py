"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The stored ledger keeps the measurements, one failure bit per rule and the
version of the rule set that gave the bits their meaning; a policy is a versioned mask over these bits, so that changing
a policy or asking what a rule costs reads the stored bits and never the texts. A policy of another rule set is refused.

Defined results: a null text counts as empty; an empty text has zero in every measurement and fails the length rule; no
cap applies to long texts; repeated rows give repeated ledger rows; an empty table gives an empty ledger; columns other
than the id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import SEPARATORS, WORD, staged, table, text_rows

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps_words")
SYMBOLS = "#*$%&|<>"

#: To be changed with RULES: stored bits mean rules of this version.
RULES_VERSION = "rules-1"
#: Bit i of fail_bits is rule i. The expressions use the measurements alone, in Spark SQL and in DuckDB alike.
RULES: tuple[tuple[str, str], ...] = (
    ("too_short", "n_words < 50"),
    ("repeated_trigrams", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    ("capitals", "2 * n_caps_words > n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A named, versioned choice of rules; a document passes if none of them failed."""

    version: str
    rules: tuple[str, ...]
    rules_version: str = RULES_VERSION

    @property
    def mask(self) -> int:
        names = [name for name, _ in RULES]
        return sum(1 << names.index(rule) for rule in self.rules)


BASE = Policy("base-1", ("too_short", "repeated_trigrams"))
PRODUCTION = Policy("web-1", tuple(name for name, _ in RULES))


def measure(text: str) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SEPARATORS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(SEPARATORS)]
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            seen: set = set()
            twice = {w for w in windows if w in seen or seen.add(w)}
            end = 0  # words before this place are counted
            for i, w in enumerate(windows):
                if w in twice:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), sum(map(bytes.isupper, words))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_rows(batches):
        rows = [measure(text or "") for text in batch.column(1).to_pylist()]
        columns = [pa.array([row[i] for row in rows], pa.int64()) for i in range(len(MEASURES))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["_id", *MEASURES])


def rule_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the measurements, fail_bits (bigint) and rules_version: one pass over the texts, no shuffle."""
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()
    made = slim.mapInArrow(_measured, f"_id {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES))
    bits = " + ".join(f"(case when {rule} then {1 << i} else 0 end)" for i, (_, rule) in enumerate(RULES))
    return made.withColumn("fail_bits", F.expr(bits).cast("bigint")).withColumn("rules_version", F.lit(RULES_VERSION)).withColumnRenamed("_id", id_col)


def stored_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """The ledger as a table of the shared folder, or of path, from which any number of policies and ablations are read."""
    ledger = rule_ledger(docs, id_col, text_col)
    if path is None:
        return staged(ledger, "ledger")
    ledger.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _bits_for(policy: Policy) -> Column:
    """fail_bits under the policy's mask; an error on rows whose bits another version of the rules has set."""
    told = F.concat(F.lit(f"policy {policy.version} is for {policy.rules_version}, the ledger has "), F.coalesce("rules_version", F.lit("none")))
    return F.when(F.col("rules_version").eqNullSafe(policy.rules_version), F.col("fail_bits").bitwiseAND(F.lit(policy.mask))).otherwise(F.raise_error(told).cast("bigint"))


def apply_policy(ledger: DataFrame, policy: Policy, name: str = "kept") -> DataFrame:
    """The ledger with a verdict column, and the policy's version as <name>_policy."""
    return ledger.withColumn(name, _bits_for(policy) == 0).withColumn(f"{name}_policy", F.lit(policy.version))


def ablation(ledger: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """Per rule of a policy: how many documents fail it, fail it alone, and would be kept without it.

    The ledger is first counted by its bit pattern (at most 2 ** rules rows), then the patterns are folded per rule."""
    counts = ledger.groupBy("fail_bits", "rules_version").agg(F.count("*").alias("n"))
    names = [name for name, _ in RULES]
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("bigint").alias("bit")) for r in policy.rules])
    per = counts.select("n", _bits_for(policy).alias("bits"), F.explode(rules).alias("r")).select("n", "bits", "r.*")
    hit = per["bits"].bitwiseAND(per["bit"]) != 0
    return per.groupBy("rule").agg(
        F.sum(F.when(hit, per["n"]).otherwise(0)).alias("n_failed"),
        F.sum(F.when(per["bits"] == per["bit"], per["n"]).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when((per["bits"] == 0) | (per["bits"] == per["bit"]), per["n"]).otherwise(0)).alias("n_kept_without"),
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = stored_ledger(table(spark, sf_dir, "documents"))
    judged = apply_policy(apply_policy(ledger, BASE, "_base"), PRODUCTION)
    return judged.select("doc_id", *MEASURES[:5], (~F.col("_base")).alias("base_failed"), "kept", "fail_bits", "rules_version", "kept_policy")


_BITS = " + ".join(f"(case when {rule} then {1 << i} else 0 end)" for i, (_, rule) in enumerate(RULES))
OP1_SQL = f"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce("text", '') AS t,
         regexp_extract_all(coalesce("text", ''), '{WORD}') AS ws,
         list_filter(string_split(coalesce("text", ''), chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS ls
  FROM documents),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(0, 3) AS r(k) GROUP BY rid),
m AS (
  SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(ls)::BIGINT AS n_lines,
         len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]')))::BIGINT AS n_caps_words
  FROM w LEFT JOIN rep USING (rid)),
b AS (SELECT *, ({_BITS})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {BASE.mask}) <> 0 AS base_failed,
       (fail_bits & {PRODUCTION.mask}) = 0 AS kept, fail_bits, '{RULES_VERSION}' AS rules_version, '{PRODUCTION.version}' AS kept_policy
FROM b
"""
