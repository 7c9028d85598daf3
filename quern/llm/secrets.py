r"""Secret scans with corpus-wide ownership frequency: DataFrame functions only.

Base patterns (assign, access, hex) always count. All values, and those of wide candidates (tokens of 24 or more mixed
characters), are hashed and counted across the corpus by distinct owners and distinct repositories: a value that several owners carry, or
many repositories of one owner, is a copied example; one of few owners and few repositories is a live-looking credential,
and a wide candidate's span is added. The counts of every match are returned with it. Positions come from the pieces
between the matches: regexp_extract_all and split with one pattern interleave exactly.

Defined results: a null text counts as empty and has no span; spans are code points, end exclusive; texts are never cut;
equal spans of one document are listed once a kind; rows that repeat are scanned each; a null owner or repository counts
as one of its own;  an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import staged, table

#: (kind, pattern, least length of the checked group, that group). Kinds in their order in the results.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
BASE = (("assign", ASSIGN), ("access", r"AKIA[A-Z0-9]{12,}+"), ("hex", r"[0-9a-f]{32,}+"))
#: Method's own kind: 24 or more characters with an upper-case letter, a lower-case letter and a digit.
WIDE = r"[A-Za-z0-9_-]{24,}+"
KINDS = ("assign", "access", "hex", "owned")
MIN_VALUE = 8
#: A value with more owners than this is a copied example.
MAX_OWNERS = 1
#: So is one in more repositories than this, whoever owns them.
MAX_REPOS = 2


def _spans(text: Column, rank: int, pattern: str, good) -> Column:
    """array<struct<start, rank, end, value>> of the matches that are good, empty where there is none."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>")
    walked = F.aggregate(
        F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), F.size(found)).alias("b")),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["b"]) + F.length(x["m"])).alias("at"),
            F.when(
                good(x["m"]),
                F.array_append(a["out"], F.struct((a["at"] + F.length(x["b"])).alias("start"), F.lit(rank).alias("rank"), (a["at"] + F.length(x["b"]) + F.length(x["m"])).alias("end"), x["m"].alias("value"))),
            )
            .otherwise(a["out"])
            .alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(text.rlike(pattern), walked).otherwise(none)


def _good_assign(m: Column) -> Column:
    return F.length(F.regexp_extract(m, ASSIGN, 2)) >= MIN_VALUE


def _good_wide(m: Column) -> Column:
    return m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")


def _always(m: Column) -> Column:
    return F.lit(True)


def ownership(candidates: DataFrame) -> DataFrame:
    """_hash, n_rows, n_owners, n_repos from rows (_hash, _owner, _repo).

    Rows are first counted by (hash, owner, repository), then folded; a value that a third of all rows has is a few
    partial rows of each task by the first step."""
    fine = candidates.groupBy("_hash", "_owner", "_repo").agg(F.count("*").alias("n"))
    mid = fine.groupBy("_hash", "_owner").agg(F.sum("n").alias("n"), F.count("*").alias("r"))
    return mid.groupBy("_hash").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_owners"), F.sum("r").alias("n_repos"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """id, base (array of spans), owned (array of spans), n_copied: matches of either sort whose value more owners or
    repositories carry than the limits say, counts: owners, repositories and rows of the value of every match. Base spans stay whatever their frequency; wide ones only if owned.

    One pass over the texts, staged without them; the frequency join takes the candidates alone."""
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("_id"), owner.cast("string").alias("_owner"), repository.cast("string").alias("_repo"), text.alias("_text"))
    t = F.col("_text")
    base = F.array_sort(F.concat(_spans(t, 0, ASSIGN, _good_assign), *[_spans(t, i, p, _always) for i, (_, p) in enumerate(BASE) if i]))
    scanned = slim.select("_id", "_owner", "_repo", base.alias("base"), _spans(t, len(BASE), WIDE, _good_wide).alias("wide"))
    scanned = staged(scanned.withColumn("_row", F.monotonically_increasing_id()), "secrets")
    every = F.concat("base", "wide")
    found = scanned.filter(F.size(every) > 0).select("_row", "_owner", "_repo", F.explode(every).alias("s"))
    secret = F.when(F.col("s.rank") == 0, F.regexp_extract("s.value", ASSIGN, 2)).otherwise(F.col("s.value"))
    found = found.withColumn("_hash", F.sha2(secret, 256))
    counts = ownership(found).select(F.col("_hash").alias("_h"), "n_owners", "n_repos", "n_rows")
    judged = found.join(counts, found["_hash"] == counts["_h"])
    own = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    kept = F.when(own & (F.col("s.rank") >= len(BASE)), F.col("s"))
    count = F.struct("s.start", "s.rank", "s.end", "n_owners", "n_repos", "n_rows")
    by_row = judged.groupBy(F.col("_row").alias("_r")).agg(F.array_sort(F.collect_list(kept)).alias("owned"), F.sum(F.when(own, 0).otherwise(1)).alias("n_copied"), F.array_sort(F.collect_list(count)).alias("counts"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>")
    no_counts = F.array().cast("array<struct<start:int,rank:int,end:int,n_owners:bigint,n_repos:bigint,n_rows:bigint>>")
    out = scanned.join(by_row, scanned["_row"] == by_row["_r"], "left")
    return out.select(F.col("_id").alias(id_col), "base", F.coalesce("owned", none).alias("owned"), F.coalesce("n_copied", F.lit(0)).cast("bigint").alias("n_copied"), F.coalesce("counts", no_counts).alias("counts"))


def op10_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("bigint")
    every = F.array_sort(F.concat("base", "owned"))
    names = F.array(*map(F.lit, (*KINDS[:-1], "wide")))
    counts = F.array_join(F.transform("counts", lambda c: F.concat_ws(":", F.element_at(names, c["rank"] + 1), c["start"], c["end"], c["n_owners"], c["n_repos"], c["n_rows"])), ",")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"), F.size("owned").cast("bigint").alias("n_owned"), "n_copied", counts.alias("counts"),
    )
