"""Nearest vectors by cells: spherical k-means centroids, and the angle bound of each cell as an exact way for the rest.

Every vector belongs to the cell of its nearest centroid, and a cell's radius is the largest angle to its centroid. A query
meets the vectors of its PROBES nearest cells first; then only those cells whose nearest possible point, by the triangle
inequality of angles, isn't beyond the k-th best found so far. Small cells share a part, large ones are dealt into several, and
a query is sent to a part once, with its k-th best: which cells it asks is decided there, so that what moves grows with
the number of parts, not of cells. Centroids, CELLS at most, are all that the driver sees."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.dialogue import operations
from quern.operators.ranking import _ROUTES, _WANTED, EVERY, products, routes, wanted
from quern.operators.retrieval import top_k
from quern.sources.staging import stored
from quern.sources.views import CATALOG_SQL, read

#: Centroids at most, rows that they are fitted on at most, cells that every query meets, vectors and queries of a part at most
#: and at least, parts to aim at, rows that meet all centroids at once.
CELLS, FIT_ROWS, PROBES, PART, ASKED, LEAST, SPREAD, ROWS = 1024, 100_000, 4, 32_768, 32_768, 2048, 8, 1024
ROOM = 1e-6
#: Weight and rank constant of the dense route.
WEIGHT, RRF, DEPTH = 0.5, 100, 20


def unit(vector: Column) -> Column:
    """The vector with length one; null for null and zero vectors."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double")))
    return F.when(length > 0, F.transform(vector, lambda x: x.cast("double") / length))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def fit_cells(vectors: DataFrame) -> np.ndarray:
    """Unit centroids of vectors (id, u)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    few = vectors if n <= FIT_ROWS else vectors.filter(F.pmod(F.xxhash64("id"), F.lit(math.ceil(n / FIT_ROWS))) == 0)
    k = min(CELLS, max(1, math.isqrt(n)))
    if k == 1:
        return np.array([r["u"] for r in few.limit(1).select("u").collect()])
    model = KMeans(k=k, maxIter=8, seed=7, distanceMeasure="cosine").fit(few.select(array_to_vector("u").alias("features")))
    centers = np.array(model.clusterCenters())
    return centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-300)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ROWS rows at most: what is compared with all centroids at once."""
    for batch in batches:
        yield from (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS))


def _placing(centers: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            near = _matrix(batch.column("u")) @ centers.T
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("u"), pa.array(near.argmax(axis=1).astype(np.int32)), pa.array(near.max(axis=1))], ["id", "u", "cell", "near"])

    return run


def _reach(near: np.ndarray, radius: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether a cell may hold something as good as least, for each query and cell."""
    angle = np.arccos(np.clip(near, -1, 1)) - np.where(np.isfinite(radius), radius, 0.0) - 1e-7
    return (np.where(angle > 0, np.cos(np.maximum(angle, 0)), 1.0) >= least[:, None] - ROOM) & np.isfinite(radius)


def _choosing(centers: np.ndarray, radius: np.ndarray, part_of: np.ndarray, n_parts: np.ndarray, first: bool) -> Callable:
    """Parts for rows (query_id, u, least): those of the PROBES nearest cells, or of all cells that may hold something as good
    as least. A query goes to a part once, however many of the part's cells it asks."""
    parts, probes = int((part_of + n_parts)[np.isfinite(radius)].max()), PROBES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            near = np.where(np.isfinite(radius), _matrix(batch.column("u")) @ centers.T, -2.0)
            if first:
                asks = np.zeros(near.shape, bool)
                np.put_along_axis(asks, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, axis=1)
            else:
                asks = _reach(near, radius, batch.column("least").to_numpy())
            wanted_ = np.zeros((len(near), parts), bool)
            for cell in np.flatnonzero(asks.any(axis=0) & np.isfinite(radius)):
                wanted_[:, part_of[cell] : part_of[cell] + n_parts[cell]] |= asks[:, cell : cell + 1]
            row, part = np.nonzero(wanted_)
            at = pa.array(row)
            yield from _pieces([pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("query_id", "u", "least")] + [pa.array(part.astype(np.int32))], ["query_id", "u", "least", "part"])])

    return run


def _meeting(k: int, others: bool, centers: np.ndarray, radius: np.ndarray, first: bool) -> Callable:
    """The k best of a part for each query that asks it. A chunk of queries meets the cells that one of them asks; products in
    single precision drop what can't reach the query's least score or its k-th best here, the rest is scored in full."""
    probes = PROBES

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        ids, asked = vectors.column("id").to_numpy(), queries.column("query_id").to_numpy()
        out: list = [(asked[:0], ids[:0], np.zeros(0))]
        if len(ids) and len(asked):
            cell = vectors.column("cell").to_numpy()
            by = np.lexsort((ids, cell))
            ids, cell, right = ids[by], cell[by], _matrix(vectors.column("u"))[by]
            quick, margin = right.astype(np.float32), right.shape[1] * 2.5e-7 + ROOM
            left, least = _matrix(queries.column("u")), queries.column("least").to_numpy()
            home = np.concatenate([(left[at : at + ROWS] @ centers.T).argmax(axis=1) for at in range(0, len(left), ROWS)])
            order = np.argsort(home, kind="stable")  # queries of one neighbourhood ask the same cells
            for at in range(0, len(order), 256):
                some = order[at : at + 256]
                own, q, floor = asked[some], left[some], least[some]
                near = np.where(np.isfinite(radius), q @ centers.T, -2.0)
                use = np.zeros(len(radius), bool)
                if first:
                    use[np.argsort(-near, axis=1, kind="stable")[:, :probes].ravel()] = True
                else:
                    use = _reach(near, radius, floor).any(axis=0)
                cols = np.flatnonzero(use[cell])
                if not len(cols):
                    continue
                sims = q.astype(np.float32) @ quick[cols].T
                if others:
                    sims[own[:, None] == ids[cols][None, :]] = -np.inf
                if len(cols) > k:  # the k-th best of what is here
                    floor = np.maximum(floor, np.partition(sims, len(cols) - k, axis=1)[:, len(cols) - k].astype(np.float64) - margin)
                row, col = np.nonzero((sims >= (floor - margin)[:, None].astype(np.float32)) & np.isfinite(sims))
                full = [np.einsum("ij,ij->i", q[row[i : i + 65536]], right[cols[col[i : i + 65536]]]) for i in range(0, len(row), 65536)]
                score, found = np.round(np.concatenate([np.zeros(0), *full]), 6), ids[cols[col]]
                rank = np.lexsort((found, -score, row))
                row, score, found = row[rank], score[rank], found[rank]
                best = np.arange(len(row)) - np.searchsorted(row, row) < k
                out.append((own[row[best]], found[best], score[best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    return run


def _dealt(n: int, most: int) -> int:
    """Rows of a part: enough parts to keep SPREAD tasks at work, none of more than most rows."""
    return max(1, min(most, max(LEAST, math.ceil(n / SPREAD))))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, others: bool = False) -> DataFrame:
    """query_id, id, score, rank: the k vectors (id, u) of largest dot product with each query (query_id, u), ties by id; all
    of unit length. others: not the vector of the query's own id."""
    vectors = stored(vectors.filter("u is not null"), "vectors")
    queries = stored(queries.filter("u is not null"), "vector-queries")
    spark = vectors.sparkSession
    if vectors.isEmpty():
        return spark.createDataFrame([], "query_id bigint, id bigint, score double, rank int")
    centers = fit_cells(vectors)
    placed = stored(vectors.mapInArrow(_placing(centers), "id bigint, u array<double>, cell int, near double"), "cells")
    size = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("near")).collect()}  # CELLS rows at most
    radius = np.full(len(centers), -np.inf)  # an empty cell is never asked
    part_of, n_parts = np.zeros(len(centers), np.int64), np.ones(len(centers), np.int64)
    room, parts, held = _dealt(sum(r["n"] for r in size.values()), PART), 0, math.inf
    for cell in sorted(size):  # small cells share a part, a large one has several
        n = size[cell]["n"]
        radius[cell] = math.acos(min(1.0, max(-1.0, size[cell]["near"])))
        n_parts[cell], fresh = math.ceil(n / room), held + n > room
        part_of[cell] = parts if fresh else parts - 1
        parts, held = (parts + int(n_parts[cell]), n if n <= room else math.inf) if fresh else (parts, held + n)
    at = F.create_map(*[F.lit(int(x)) for c in sorted(size) for x in (c, part_of[c])])[F.col("cell")]
    of = F.create_map(*[F.lit(int(x)) for c in sorted(size) for x in (c, n_parts[c])])[F.col("cell")]
    shares = math.ceil(max(1, n_queries := queries.count()) / _dealt(n_queries, ASKED))
    dealt = placed.select("id", "u", "cell", (at + F.pmod(F.xxhash64("id"), of)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("of"))

    def met(known: DataFrame, first: bool) -> DataFrame:
        """The k best of each query (query_id, u, least) in each part that it asks."""
        asked = known.select("query_id", "u", "least").mapInArrow(_choosing(centers, radius, part_of, n_parts, first), "query_id bigint, u array<double>, least double, part int")
        asked = asked.select("query_id", "u", "least", F.col("part").alias("p"), F.pmod(F.xxhash64("query_id"), F.lit(shares)).cast("int").alias("o"))
        return dealt.groupBy("part", "of").cogroup(asked.groupBy("p", "o")).applyInArrow(_meeting(k, others, centers, radius, first), "query_id bigint, id bigint, score double")

    near = stored(met(queries.withColumn("least", F.lit(-2.0)), True), "near-cells")
    worst = top_k(near, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    known = queries.join(worst, "query_id", "left").na.fill({"least": -2.0})
    return top_k(met(known, False), k).select("query_id", "id", "score", "rank")


def dense_topk(spark: SparkSession, sf_dir: str, k: int = 10, every: int = 50) -> DataFrame:
    """Nearest vectors of every vector whose id divides by 50, by dot product of unit vectors."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), unit(F.col("embedding")).alias("u"))
    return nearest(v, v.filter(F.col("id") % every == 0).withColumnRenamed("id", "query_id"), k, others=True)


_UNIT = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))"
DENSE_SQL = f"""WITH v AS (SELECT vec_id, {_UNIT} AS u FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_dot_product(q.u, v.u), 6) AS score FROM v q, v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10"""


def hard_filtered(ranked: DataFrame, groups: DataFrame, items: DataFrame) -> DataFrame:
    """Ranked products (query_id, id, score, rank) whose text holds all tokens of every hard group (query_id, groups) of their
    query (F7); the rank counts those left out. weighted: the route's part of a fused score (R7)."""
    x = ranked.join(groups, "query_id").join(items.select(F.col("asin").alias("id"), "text"), "id")
    fits = F.forall("groups", lambda g: F.forall(g, lambda t: F.contains("text", t)))
    weighted = WEIGHT * F.col("score") / (RRF + F.col("rank"))
    return x.filter(fits).select("query_id", "id", "rank", "score", (F.signum(weighted) * F.floor(F.abs(weighted) * 1e8 + 0.5) / 1e8).alias("weighted"))  # halves of the double itself


def dense_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense route of each session: the DEPTH nearest product vectors, those that miss a hard constraint left out.

    A product's vector has its key as id. No encoder is at hand, so a session asks with the vector numbered by the product
    of its last turn."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), unit(F.col("embedding")).alias("u"))
    items = products(spark, sf_dir)
    owned = v.join(items.select(F.col("asin").cast("bigint").alias("id")), "id", "left_semi")
    ops = operations(spark, sf_dir).filter(F.col("session_id") % EVERY == 0)
    last = ops.groupBy(F.col("session_id").cast("bigint").alias("query_id")).agg(F.max_by("asin", "turn").alias("asin"))
    n = v.count()
    asked = last.withColumn("id", F.pmod("asin", F.lit(max(1, n)))).join(v, "id").select("query_id", "u")
    # sessions that ask with the same vector are one query
    same = stored(asked.withColumn("vector", F.xxhash64("u")), "session-vectors")
    ranked = nearest(owned, same.groupBy(F.col("vector").alias("query_id")).agg(F.first("u").alias("u")), DEPTH)
    ranked = same.select("query_id", "vector").join(ranked.withColumnRenamed("query_id", "vector"), "vector").drop("vector")
    return hard_filtered(ranked, routes(wanted(spark, sf_dir)).select("query_id", "groups"), items)


ROUTE_SQL = f"""WITH RECURSIVE {_WANTED}, {CATALOG_SQL}, {_ROUTES}, v AS (SELECT vec_id, {_UNIT} AS u FROM embeddings),
pr AS (SELECT asin, lower(concat_ws(' ', title, category, store, size)) AS text FROM catalog),
la AS (SELECT session_id AS query_id, arg_max(asin, turn) % (SELECT count(*) FROM embeddings) AS vec_id FROM ops WHERE session_id % {EVERY} = 0 GROUP BY 1),
s AS (SELECT query_id, asin AS id, text, round(list_dot_product(q.u, v.u), 6) AS score FROM la JOIN v q USING (vec_id), v JOIN pr ON pr.asin = v.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, rank, score, round({WEIGHT} * score / ({RRF} + rank), 8)::DOUBLE AS weighted FROM k JOIN rt USING (query_id)
WHERE rank <= {DEPTH} AND len(list_filter(flatten(groups), lambda t: NOT contains(text, t))) = 0"""

QUERIES = {f.__name__: f for f in (dense_topk, dense_route)}
SQL = dict(zip(QUERIES, (DENSE_SQL, ROUTE_SQL), strict=True))
