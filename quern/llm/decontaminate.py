"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A short test item inside a long document has a tiny Jaccard similarity to it, so what is searched is containment: the
share of the item's distinct five-word shingles that the document has. Items are partitioned by size (powers of two of
their number of shingles). A partition with at most u shingles an item keeps, of each item, the MinHash sketch of its
s = floor((1 - t) * u) + 1 smallest shingle hashes. An item that is contained to t or more lacks at most s - 1 shingles, so
one of its s sketch hashes at least must occur among the document's: the search loses nothing, whatever the document's
length. Candidates are then compared by their whole sets of shingles (strings, no hashes).

The sketches and items are broadcast while the test set has at most broadcast_chars characters; beyond it the documents'
shingle hashes meet the sketches in a shuffled join and candidates are verified from the joined texts.

Defined results: words are maximal runs of letters and digits, lower-cased; an item of one to four words is one shingle
(its whole sequence) and is looked for as such; null or empty items and documents match nothing; repeated rows give
repeated results in the document table and one row for each (id, item) pair in the pairs; empty tables give no pairs.
Ids of documents and items may be of any type. Columns other than ids and texts are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from quern.llm.common import row_key, table, text_rows

WORDS, THRESHOLD = 5, 0.8
BROADCAST_CHARS = 4_000_000
_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def shingles(words: list[str], size: int = WORDS) -> set[str]:
    if not words:
        return set()
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def _hash(shingle: str) -> int:
    return xxhash.xxh64_intdigest(shingle, 7)


def sketch_size(n: int, threshold: float = THRESHOLD) -> int:
    """Sketch length of the size partition that holds items of n shingles."""
    upper = 1 << max(0, n - 1).bit_length()
    return min(n, int((1 - threshold) * upper + 1e-9) + 1)


def sketch(item: set[str], threshold: float = THRESHOLD) -> list[int]:
    return sorted(map(_hash, item))[: sketch_size(len(item), threshold)]


def _contained(item: set[str], words: list[str], whole: dict[int, set[str]]) -> int:
    """How many of item's shingles the document has; items under WORDS words have one shorter shingle."""
    size = min(WORDS, next(iter(item)).count(" ") + 1)
    if size not in whole:
        whole[size] = shingles(words, size)
    return len(item & whole[size])


class _Search:
    """Pairs of the broadcast items in batches of documents."""

    def __init__(self, items: list[tuple], threshold: float):
        self.threshold = threshold
        self.items = [(i, s) for i, text in items if (s := shingles(tokens(text)))]
        self.sizes = sorted({min(WORDS, next(iter(s)).count(" ") + 1) for _, s in self.items})
        self.table: dict[int, list[int]] = {}
        for at, (_, s) in enumerate(self.items):
            for h in sketch(s, threshold):
                self.table.setdefault(h, []).append(at)
        self.keys = self.table.keys()

    def found(self, text: str | None) -> list[tuple]:
        words = tokens(text)
        whole: dict[int, set[str]] = {}
        at: set[int] = set()
        for size in self.sizes:
            if len(words) >= size:
                whole[size] = shingles(words, size)
                for h in self.keys & set(map(_hash, whole[size])):
                    at.update(self.table[h])
        got = []
        for i in sorted(at):
            item_id, s = self.items[i]
            n = _contained(s, words, whole)
            if n >= self.threshold * len(s) - 1e-9:
                got.append((item_id, n, len(s)))
        return got


def _pairs(spark: SparkSession, slim: DataFrame, items: list[tuple], item_kind: DataType, threshold: float) -> DataFrame:
    item_type = to_arrow_type(item_kind)
    shared = spark.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(shared.value, threshold)
        for batch in text_rows(batches):
            at, item, n, size = [], [], [], []
            for row, text in enumerate(batch.column("_text").to_pylist()):
                for i, hits, of in search.found(text):
                    at.append(row)
                    item.append(i)
                    n.append(hits)
                    size.append(of)
            keys = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(item, item_type), pa.array(n, pa.int64()), pa.array(size, pa.int64())], ["_id", "_rk", "_rk2", "item_id", "n_shared", "n_shingles"])

    kind = slim.schema["_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"_id {kind}, _rk bigint, _rk2 int, item_id {item_kind.simpleString()}, n_shared bigint, n_shingles bigint")


def _hash_rows(of_items: bool, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_rows(batches, 64):
            at, h = [], []
            for row, text in enumerate(batch.column("_text").to_pylist()):
                words = tokens(text)
                if of_items:
                    values = sketch(s, threshold) if (s := shingles(words)) else []
                else:
                    values = sorted({_hash(x) for size in range(1, WORDS + 1) if len(words) >= size for x in shingles(words, size)})
                at += [row] * len(values)
                h += values
            keys = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(np.array(h, np.uint64).view(np.int64))], ["_id", "_rk", "_rk2", "_h"])

    return run


def _joined_pairs(slim: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """For test sets too large to broadcast: sketches meet the documents' hashes in a join on the hash."""
    kind, item_kind = slim.schema["_id"].dataType.simpleString(), items.schema["_id"].dataType.simpleString()
    left = slim.mapInArrow(_hash_rows(False, threshold), f"_id {kind}, _rk bigint, _rk2 int, _h bigint")
    right = items.mapInArrow(_hash_rows(True, threshold), f"_id {item_kind}, _rk bigint, _rk2 int, _h bigint")
    right = right.select(F.col("_rk").alias("_irk"), F.col("_rk2").alias("_irk2"), "_h").distinct()
    candidates = left.join(right, "_h").select("_rk", "_rk2", "_irk", "_irk2").distinct()
    docs = slim.dropDuplicates(["_rk", "_rk2"])
    tests = items.select(F.col("_id").alias("item_id"), F.col("_text").alias("_item"), F.col("_rk").alias("_irk"), F.col("_rk2").alias("_irk2")).dropDuplicates(["_irk", "_irk2"])
    both = candidates.join(tests, ["_irk", "_irk2"]).join(docs, ["_rk", "_rk2"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_rows(batches):
            at, n, size = [], [], []
            for row, (text, item) in enumerate(zip(batch.column("_text").to_pylist(), batch.column("_item").to_pylist(), strict=True)):
                s = shingles(tokens(item))
                hits = _contained(s, tokens(text), {})
                if hits >= threshold * len(s) - 1e-9:
                    at.append(row)
                    n.append(hits)
                    size.append(len(s))
            rows = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(n, pa.int64()), pa.array(size, pa.int64())], ["_id", "_rk", "_rk2", "item_id", "n_shared", "n_shingles"])

    return both.select("_id", "_rk", "_rk2", "item_id", "_text", "_item").mapInArrow(verify, f"_id {kind}, _rk bigint, _rk2 int, item_id {item_kind}, n_shared bigint, n_shingles bigint")


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """_id, _rk, _rk2, item_id (of the items' own type), n_shared, n_shingles: one row for each document row and item contained to threshold or more."""
    slim = docs.select(F.col(id_col).alias("_id"), *row_key(F.col(id_col), F.col(text_col)), F.col(text_col).alias("_text"))
    tests = items.select(F.col(item_id).alias("_id"), *row_key(F.col(item_id), F.col(item_text)), F.col(item_text).alias("_text"))
    size = tests.agg(F.sum(F.length("_text") + 16)).first()[0] or 0
    if size > broadcast_chars:
        return _joined_pairs(slim, tests, threshold)
    rows = [(r["_id"], r["_text"]) for r in tests.select("_id", "_text").distinct().collect()]  # bounded by the check above
    return _pairs(docs.sparkSession, slim, rows, tests.schema["_id"].dataType, threshold)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that contain no test item, all columns kept."""
    one, two = row_key(F.col(id_col), F.col(text_col))
    dirty = contained_items(docs, items, id_col, text_col, **options).select(F.col("_rk").alias("_dirty1"), F.col("_rk2").alias("_dirty2")).distinct()
    return docs.join(dirty, (one == F.col("_dirty1")) & (two == F.col("_dirty2")), "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.select(F.col("_id").alias("doc_id"), "item_id", "n_shared", "n_shingles").distinct()


def _sql_shingles(name: str, key: str, source: str) -> str:
    return f"""{name}_w AS (SELECT {key}, regexp_extract_all(lower("text"), '[\\p{{L}}\\p{{N}}]+') AS ws FROM {source} WHERE "text" IS NOT NULL)"""


OP3_SQL = f"""
WITH {_sql_shingles("i", "item_id", "benchmark")}, {_sql_shingles("d", "doc_id", "documents")},
i_s AS (SELECT DISTINCT item_id, least(len(ws), {WORDS}) AS size,
          array_to_string(ws[p:p + least(len(ws), {WORDS}) - 1], ' ') AS s
        FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - {WORDS - 1}) + 1)) AS p FROM i_w WHERE len(ws) > 0)),
i_n AS (SELECT item_id, count(*)::BIGINT AS n_shingles FROM i_s GROUP BY item_id),
d_s AS (SELECT DISTINCT doc_id, size, array_to_string(ws[p:p + size - 1], ' ') AS s
        FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS p
              FROM d_w, (SELECT DISTINCT size FROM i_s) WHERE len(ws) >= size))
SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, any_value(n_shingles) AS n_shingles
FROM d_s JOIN i_s USING (size, s) JOIN i_n USING (item_id)
GROUP BY doc_id, item_id HAVING 10 * count(*) >= {round(THRESHOLD * 10)} * any_value(n_shingles)
"""
