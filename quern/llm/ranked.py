"""Ranked search with integer impacts: MaxScore whose bounds know which terms occur together.

One pass tokenises the documents where they are read and keeps, of the terms that some query asks for, each document's
frequencies; every task adds up its numbers of documents and terms. Documents are dealt by hash into shards, and a shard's
index is built once and stored: for each term the documents and impacts, and for each pair of terms that a query
puts together the intersection of their lists with the documents' joint impacts.

A query pairs its terms by falling weight, and a pair's bound is the largest of its joint maximum and the two terms' own maxima:
never over their sum, and far below it where the terms don't meet. Pairs are taken by rising bound; those whose bounds sum to
less than the threshold can't lift a document into the result alone, so only the documents of the other lists are
candidates. The threshold is the k-th best of what is known of the shard, or of the shards searched before. The rest is added
pair by pair, highest bound first, by looking candidates up, in the intersection before the single lists, and a candidate
goes as soon as its score and the bounds that are left stay below the threshold.

FIRST shards are searched first, and their k-th score is every other shard's threshold from the start, so that what is merged
doesn't grow with the number of shards. Queries beyond BLOCK_TERMS terms are run in blocks, chosen by hash.

Defined results: texts that are null or have no term are no documents; a query without terms has no rows; repeated documents
rank each on its own, equal scores by id, nulls first; an item id that comes with several texts is a query for each text, rows of
equal id and text are one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import staged, table
from quern.llm.pieces import filled, text_slices

TOP, SLICE, BLOCK_TERMS = 50, 4 << 20, 200_000
#: Shards have about SHARD postings; there are FIRST at least, and as many are searched first.
SHARD, FIRST = 1_000_000, 32
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_IN_TERM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, and where each text's terms begin (and the end)."""
    if not len(texts):
        return pa.array([], pa.large_string()), np.zeros(1, np.int64)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    inside = _IN_TERM[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = bounds[:-1][bounds[:-1] < len(data)]
    begins[heads] = inside[heads]
    kept = _FOLD[data[inside]]
    place = np.append(np.flatnonzero(begins[inside]), len(kept)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(place) - 1, [None, pa.py_buffer(place), pa.py_buffer(kept)])
    return words, np.append(0, np.cumsum(begins))[bounds]


def _posting(vocabulary: list[str], id_type: pa.DataType) -> Callable:
    schema = pa.schema([("id", id_type), ("n", pa.int64()), ("terms", pa.binary()), ("tfs", pa.binary()), ("term", pa.int32()), ("df", pa.int64()), ("n_docs", pa.int64()), ("n_terms", pa.int64())])

    def batch_of(rows: int, have: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([have.get(f.name, pa.nulls(rows, f.type)) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(vocabulary, pa.large_string())
        df, n_docs, n_terms = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in text_slices(batches, "_text", SLICE):
            words, bounds = terms_of(filled(batch.column("_text")))
            n = np.diff(bounds)
            n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
            code = pc.fill_null(pc.index_in(words, value_set=wanted), -1).to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(n)), n)[code >= 0]
            keys, tf = np.unique((owner << 32) | code[code >= 0], return_counts=True)
            term = keys & 0xFFFFFFFF
            df += np.bincount(term, minlength=len(df))
            docs, first = np.unique(keys >> 32, return_index=True)
            at = (4 * np.append(first, len(keys))).astype(np.int32)
            binary = lambda x: pa.Array.from_buffers(pa.binary(), len(docs), [None, pa.py_buffer(at), pa.py_buffer(x.astype("<u4"))])  # noqa: E731, B023
            yield batch_of(len(docs), {"id": batch.column("_id").take(pa.array(docs)), "n": pa.array(n[docs]), "terms": binary(term), "tfs": binary(tf)})
        seen = np.flatnonzero(df)
        yield batch_of(len(seen), {"term": pa.array(seen.astype(np.int32)), "df": pa.array(df[seen])})
        yield batch_of(1, {"n_docs": pa.array([n_docs]), "n_terms": pa.array([n_terms])})

    return run


def _pairs(terms: list[int], weights: np.ndarray) -> list[tuple[int, int]]:
    """A query's terms in pairs by falling weight; the last may stand alone (-1)."""
    by = sorted((t for t in terms if weights[t] > 0), key=lambda t: (-weights[t], t))
    return list(zip(by[::2], [*by[1::2], -1] if len(by) % 2 else by[1::2], strict=True))


def _building(weights: np.ndarray, n_docs: int, n_terms: int, pairs: np.ndarray, id_type: pa.DataType) -> Callable:
    schema = pa.schema([("shard", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("ordinals", pa.binary()), ("impacts", pa.binary()), ("ids", pa.list_(id_type))])

    def run(docs: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        docs = docs.take(pc.sort_indices(docs.column("id"), null_placement="at_start")).combine_chunks()  # equal scores go by id
        shard = docs.column("shard")[0].as_py()
        read = lambda name: np.frombuffer(b"".join(docs.column(name).to_pylist()), "<u4").astype(np.int64)
        term, tf = read("terms"), read("tfs")
        owner = np.repeat(np.arange(docs.num_rows), pc.binary_length(docs.column("terms")).to_numpy() // 4)
        m = 50 + 50 * docs.column("n").to_numpy() * n_docs // n_terms
        impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[owner]))
        by = np.argsort(term, kind="stable")
        owner, impact = owner[by], impact[by]
        at = np.append(0, np.cumsum(np.bincount(term, minlength=len(weights))))
        a, b, ordinals, impacts = [], [], [], []
        for t in np.flatnonzero(np.diff(at)).tolist():
            a.append(t), b.append(-1), ordinals.append(owner[at[t] : at[t + 1]].astype("<u4").tobytes()), impacts.append(impact[at[t] : at[t + 1]].astype("<i8").tobytes())
        for x, y in pairs.tolist():
            if at[x + 1] > at[x] and at[y + 1] > at[y]:
                both, i, j = np.intersect1d(owner[at[x] : at[x + 1]], owner[at[y] : at[y + 1]], assume_unique=True, return_indices=True)
                if len(both):
                    a.append(x), b.append(y), ordinals.append(both.astype("<u4").tobytes()), impacts.append((impact[at[x] + i] + impact[at[y] + j]).astype("<i8").tobytes())
        n = len(a) + 1
        ids = pa.concat_arrays(docs.column("id").chunks)
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids), *[len(ids)] * (n - 1)], pa.int32()), ids)
        return pa.Table.from_arrays([pa.array([shard] * n, pa.int32()), pa.array([-1, *a], pa.int32()), pa.array([-1, *b], pa.int32()), pa.array([b"", *ordinals], pa.binary()), pa.array([b"", *impacts], pa.binary()), lists], schema=schema)

    return run


_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _look_up(found: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Impact of each candidate in a list (0: not in it), and whether it is in it."""
    ordinals, impacts = lists
    if not len(ordinals):
        return np.zeros(len(found), np.int64), np.zeros(len(found), bool)
    place = np.minimum(np.searchsorted(ordinals, found), len(ordinals) - 1)
    hit = ordinals[place] == found
    return np.where(hit, impacts[place], 0), hit


def best_of(pairs: list[tuple[int, int]], single: dict, joint: dict, size: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Ordinals and scores of a shard's k best documents of at least `least`, by falling score, then by ordinal."""
    units = []
    for x, y in pairs:
        top = max(single[x][2] if x in single else 0, single[y][2] if y in single else 0, joint[x, y][2] if (x, y) in joint else 0)
        if top:
            units.append((top, x, y))
    units.sort()
    below = np.append(0, np.cumsum([u[0] for u in units], dtype=np.int64))
    score = np.zeros(size, np.int64)
    left, least = len(units), max(least, 1)
    while left and below[left] >= least:  # essential: with this pair the rest can reach the threshold
        left -= 1
        for t in units[left][1:]:
            if t in single:
                score[single[t][0]] += single[t][1]
        known = np.count_nonzero(score)
        if known >= k and below[left] >= least:
            least = max(least, int(np.partition(score, size - k)[size - k]))
    found = np.flatnonzero(score)
    got = score[found]
    if len(found) > k:
        least = max(least, int(np.partition(got, len(got) - k)[len(got) - k]))
    for u in range(left - 1, -1, -1):
        stay = got + below[u + 1] >= least
        found, got = found[stay], got[stay]
        _, x, y = units[u]
        more, both = _look_up(found, joint.get((x, y), (*_NONE, 0))[:2])
        alone = np.flatnonzero(~both)
        for t in (x, y):
            if t in single:
                more[alone] += _look_up(found[alone], single[t][:2])[0]
        got = got + more
        if len(found) > k:
            least = max(least, int(np.partition(got, len(got) - k)[len(got) - k]))
    stay = got >= least
    found, got = found[stay], got[stay]
    by = np.lexsort((found, -got))[:k]
    return found[by], got[by]


def _searching(queries: list[tuple[int, list[tuple[int, int]]]], k: int, least: dict[int, int], id_type: pa.DataType) -> Callable:
    schema = pa.schema([("query", pa.int32()), ("id", id_type), ("score", pa.int64())])

    def run(index: pa.Table) -> pa.Table:
        index = index.combine_chunks()
        single, joint, ids = {}, {}, None
        for x, y, o, i, row in zip(index.column("a").to_pylist(), index.column("b").to_pylist(), index.column("ordinals").to_pylist(), index.column("impacts").to_pylist(), range(index.num_rows)):
            impacts = np.frombuffer(i, "<i8")
            if x < 0:
                ids = index.column("ids")[row].values
            elif y < 0:
                single[x] = (np.frombuffer(o, "<u4").astype(np.int64), impacts, int(impacts.max()))
            else:
                joint[x, y] = (np.frombuffer(o, "<u4").astype(np.int64), impacts, int(impacts.max()))
        out, of = [], []
        for q, pairs in queries:
            found, got = best_of(pairs, single, joint, len(ids), k, least.get(q, 1))
            out.append((found, got))
            of.append(np.full(len(found), q, np.int32))
        found, got = (np.concatenate([o[n] for o in out]) if out else _NONE[0] for n in (0, 1))
        return pa.Table.from_arrays([pa.array(np.concatenate(of) if of else np.zeros(0, np.int32)), ids.take(pa.array(found)), pa.array(got)], schema=schema)

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("id"))
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def _search_block(docs: DataFrame, items: list[tuple], k: int) -> DataFrame:
    """query (place in items), id, score, rank."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kind = docs.schema["_id"].dataType
    name, arrow = kind.simpleString(), to_arrow_type(kind)
    vocabulary = sorted({t for _, terms in items for t in terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    posted = staged(docs.mapInArrow(_posting(vocabulary, arrow), f"id {name}, n bigint, terms binary, tfs binary, term int, df bigint, n_docs bigint, n_terms bigint"), "postings")
    total = posted.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l"), F.sum("df").alias("p")).first()
    n_docs, n_terms = total["n"] or 0, total["l"] or 0
    df = np.zeros(len(vocabulary), np.int64)
    for r in posted.filter("term is not null").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row a term of the block
        df[r["term"]] = r["df"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)
    queries = [(q, _pairs([number[t] for t in terms], weights)) for q, (_, terms) in enumerate(items)]
    pairs = np.array(sorted({p for _, ps in queries for p in ps if p[1] >= 0}), np.int64).reshape(-1, 2)
    shards = max(FIRST, math.ceil((total["p"] or 0) / SHARD))
    dealt = posted.filter("n is not null").select("id", "n", "terms", "tfs", F.pmod(F.xxhash64("id", "terms", "tfs"), F.lit(shards)).cast("int").alias("shard"))
    schema = f"shard int, a int, b int, ordinals binary, impacts binary, ids array<{name}>"
    index = staged(dealt.groupBy("shard").applyInArrow(_building(weights, n_docs, max(n_terms, 1), pairs, arrow), schema), "index")
    search = lambda part, least: part.groupBy("shard").applyInArrow(_searching(queries, k, least, arrow), f"query int, id {name}, score bigint")
    first = staged(_top(search(index.filter(F.col("shard") < FIRST), {}), k), "first-shards")
    if shards == FIRST:
        return first
    least = {r["query"]: r["score"] for r in first.filter(F.col("rank") == k).select("query", "score").collect()}  # a row a query of the block
    return _top(first.drop("rank").unionByName(search(index.filter(F.col("shard") >= FIRST), least)), k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item id, rank, document id, score: the k best documents of each item."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    asked = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).distinct()
    terms = F.array_sort(F.array_distinct(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(f"({TERM})"), 1)))
    asked = staged(asked.select("item", terms.alias("terms"), F.xxhash64("item", "text").alias("h")).filter("size(terms) > 0"), "items")
    size = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_TERMS))
    kind = asked.schema["item"].dataType.simpleString()
    out = None
    for b in range(blocks):
        rows = asked.filter(F.pmod("h", F.lit(blocks)) == b).orderBy("h").select("item", "terms").collect()  # about BLOCK_TERMS terms
        names = F.broadcast(spark.createDataFrame([(q, r["item"]) for q, r in enumerate(rows)], f"query int, `{item_id}` {kind}"))
        found = _search_block(slim, [tuple(r) for r in rows], k).join(names, "query")
        found = found.select(item_id, "rank", F.col("id").alias(id_col), "score")
        out = found if out is None else out.unionByName(found)
    return out


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SPLIT = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')"
OP13_SQL = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_SPLIT} AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
p AS (SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, n_docs),
q AS (SELECT DISTINCT item_id, unnest({_SPLIT}) AS term FROM benchmark),
r AS (SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= {TOP}"""
