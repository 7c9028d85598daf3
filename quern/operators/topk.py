"""The best k of many queries without scoring every pair: block upper bounds over clustered rows.

Rows are dealt into shards by hash. Within a shard they are sorted by a cluster key, so that a block of BLOCK rows next to each
other has much in common, and the largest value of each part of a score over a block bounds what its rows can reach.
A query visits blocks by falling bound and stops when the next bound is below its k-th best score: rows of all other blocks
are never scored. Queries are made distinct before they are asked, go out in blocks of QUERIES, and only a shard's k best
of each query leave its task."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.staging import stored

BLOCK, SHARD, QUERIES, FEW, SPREAD, WHOLE = 8, 4096, 20_000, 512, 32_000_000, 20_000
#: Scores are compared after rounding to six places, so bounds have that much room.
ROOM = 1e-6


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All whole numbers of [start, end) for each pair, one pair after the other."""
    n = ends - starts
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - starts, n)


def best_blocks(bound: np.ndarray, edges: np.ndarray, score: Callable[[np.ndarray], np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and scores of the visited blocks: all rows that can be among the k best. bound: of each block, -inf for those
    that aren't asked; edges: where each block begins (and the end)."""
    order = np.argsort(-bound, kind="stable")
    order = order[np.isfinite(bound[order])]
    rows, scores, at, step, least = [], [], 0, 2, -math.inf
    while at < len(order):
        some = order[at : at + step]
        some = some[bound[some] >= least - ROOM]
        if not len(some):
            break
        rows.append(ranges(edges[some], edges[some + 1]))
        scores.append(score(rows[-1]))
        at, step = at + step, 2 * step
        got = np.concatenate(scores)
        if len(got) >= k:
            least = np.partition(got, len(got) - k)[len(got) - k]
    return (np.concatenate(rows), np.concatenate(scores)) if rows else (np.zeros(0, np.int64), np.zeros(0))


def cut(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by rounded score, then by id."""
    return np.lexsort((ids[rows], -np.round(scores, 6)))[:k]


class Lists:
    """A shard's postings: rows of each term with their parts, and the largest part of each term and block."""

    def __init__(self, table: pa.Table):
        rows = table.select(["cluster", "id"]).combine_chunks()
        ids, cluster = rows.column("id").to_numpy(), rows.column("cluster").combine_chunks().dictionary_encode()
        cluster = cluster.combine_chunks() if isinstance(cluster, pa.ChunkedArray) else cluster
        names = np.array(cluster.dictionary.to_pylist(), object)
        rank = np.argsort(np.argsort(names, kind="stable"), kind="stable")[cluster.indices.to_numpy()]
        by = np.lexsort((ids, rank))
        first = np.append(True, ids[by][1:] != ids[by][:-1]) if len(by) else np.zeros(0, bool)
        row = np.empty(len(by), np.int64)
        row[by] = np.cumsum(first) - 1
        self.ids = ids[by][first]
        self.edges = np.append(np.arange(0, len(self.ids), BLOCK), len(self.ids))
        terms = table.column("term").combine_chunks().dictionary_encode()
        terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
        code, part = terms.indices.to_numpy(), table.column("part").to_numpy()
        by = np.lexsort((row, code))
        at = np.append(0, np.cumsum(np.bincount(code, minlength=len(terms.dictionary))))
        row, part = row[by], part[by]
        self.lists = {t: (row[s:e], part[s:e]) for t, s, e in zip(terms.dictionary.to_pylist(), at, at[1:])}
        self.tops = {}
        for t, (rows_, parts) in self.lists.items():
            block = rows_ // BLOCK
            starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            self.tops[t] = (block[starts], np.maximum.reduceat(parts, starts))

    def score(self, terms: list[str], rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows))
        for t in terms:
            if t in self.lists:
                own, parts = self.lists[t]
                place = np.minimum(np.searchsorted(own, rows), len(own) - 1)
                out += np.where(own[place] == rows, parts[place], 0.0)
        return out

    def holding(self, must: list[str], one_of: list[str] | None) -> np.ndarray:
        """Rows that hold all terms of must, the rarest first, and one of the others if they are given."""
        if any(t not in self.lists for t in must):
            return np.zeros(0, np.int64)
        first, *rest = sorted(must, key=lambda t: len(self.lists[t][0]))
        rows = self.lists[first][0]
        has = lambda t, r: self.lists[t][0][np.minimum(np.searchsorted(self.lists[t][0], r), len(self.lists[t][0]) - 1)] == r
        for t in rest:
            rows = rows[has(t, rows)]
        if one_of is not None:
            fits = np.zeros(len(rows), bool)
            for t in one_of:
                if t in self.lists:
                    fits |= has(t, rows)
            rows = rows[fits]
        return rows

    def best(self, terms: list[str], must: list[str] | None, one_of: list[str] | None, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best rows with a score over 0 (with must: of all rows that hold it), and how many were scored."""
        if must:
            rows = self.holding(must, one_of)
            scores = self.score(terms, rows)
            if terms:
                rows, scores = rows[scores > 0], scores[scores > 0]
        else:
            bound = np.zeros(len(self.edges) - 1)
            for t in terms:
                if t in self.tops:
                    block, top = self.tops[t]
                    bound[block] += top
            bound[bound <= 0] = -math.inf
            rows, scores = best_blocks(bound, self.edges, lambda r: self.score(terms, r), k)
            rows, scores = rows[scores > 0], scores[scores > 0]
        keep = cut(rows, scores, self.ids, k)
        return self.ids[rows[keep]], scores[keep], len(rows)

    def whole(self, terms: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
        """best() of terms alone by adding whole lists up: cheaper where the rows are few."""
        every = np.zeros(len(self.ids))
        for t in terms:
            if t in self.lists:
                own, parts = self.lists[t]
                every[own] += parts
        rows = np.flatnonzero(every > 0)
        if len(rows) > k:
            rows = rows[every[rows] >= np.partition(every[rows], len(rows) - k)[len(rows) - k] - ROOM]
        rows = rows[cut(rows, every[rows], self.ids, k)]
        return self.ids[rows], every[rows]


class Members:
    """The rows that each searched row stands for, by their ids."""

    def __init__(self, leads: np.ndarray, members: pa.ListArray):
        by = np.argsort(leads, kind="stable")
        self.leads, self.ids = leads[by], members.flatten().to_numpy()
        ends = np.cumsum(members.value_lengths().to_numpy())
        self.starts, self.ends = (ends - members.value_lengths().to_numpy())[by], ends[by]

    def best(self, leads: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best of all rows that the leads, best first, stand for. Rows after the k-th have lower scores."""
        at = np.searchsorted(self.leads, leads)
        n = self.ends[at] - self.starts[at]
        enough = np.flatnonzero(np.cumsum(n) >= k)
        if len(enough):
            some = np.round(scores, 6) >= np.round(scores[enough[0]], 6)
            at, n, scores = at[some], n[some], scores[some]
        ids, scores = self.ids[ranges(self.starts[at], self.ends[at])], np.repeat(scores, n)
        keep = cut(np.arange(len(ids)), scores, ids, k)
        return ids[keep], scores[keep]


def _searching(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(table: pa.Table, asked: pa.Table) -> pa.Table:
        queries = asked.to_pylist() if table.num_rows else []
        if queries:
            table = table.combine_chunks()
            held, members = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (table.column("held"), table.column("members")))
            of, flat = pc.list_parent_indices(held), held.flatten()
            lists = Lists(pa.table({"id": table.column("id").take(of), "cluster": table.column("cluster").take(of), "term": flat.field("term"), "part": flat.field("part")}))
            stand_for = Members(table.column("id").to_numpy(), members)
        out = [lists.best(q["terms"] or [], q["must"], q["one_of"], k)[:2] if q["must"] or len(lists.ids) > WHOLE else lists.whole(q["terms"] or [], k) for q in queries]
        out = [stand_for.best(*o, k) for o in out]
        names = [q["ask"] for q, o in zip(queries, out) if len(o[0])]
        ids, scores = (np.concatenate([np.zeros(0, t), *[o[n] for o in out]]) for n, t in enumerate((np.int64, float)))
        ends = np.append(0, np.cumsum([len(o[0]) for o in out if len(o[0])])).astype(np.int32)
        hits = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(ids), pa.array(scores)], ["id", "score"]))
        return pa.table({"ask": pa.array(names, pa.string()), "hits": hits})

    return run


def term_lists(postings: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """ask, hits: id and score of the k best of each query by the rounded sum of its terms' parts, ties by id, best first.

    postings: id (bigint), cluster, term, part; asked: distinct ask (a name), terms, and must and one_of (arrays or null):
    only rows that hold all terms of must and one of one_of. Rows with the same terms and parts score the same in every
    query: they are searched as one, by their smallest id, and the first k of them by id go along, since whatever beats a
    group's first row beats the group. Each shard of groups meets each part of the queries in a task."""
    from quern.operators.retrieval import top_k

    rows = postings.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term", "part"))).alias("held"), F.min("cluster").alias("cluster"))
    firsts = top_k(rows, k, "held", ("id",))
    lead = stored(firsts.groupBy("held").agg(F.min("id").alias("id"), F.min_by("cluster", "id").alias("cluster"), F.array_sort(F.collect_list("id")).alias("members")), "leads")
    asked = stored(asked.select("ask", "terms", "must", "one_of").distinct(), "asked")
    n, m = lead.agg(F.sum(F.size("held") + F.size("members"))).first()[0] or 0, asked.count()
    shards = max(1, math.ceil(n / (64 * SHARD)))
    # small parts keep more tasks at work, as long as sending the rows to all of them stays cheap
    parts = max(1, min(math.ceil(m / FEW), max(math.ceil(m / QUERIES), SPREAD // max(1, n))))
    dealt = lead.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("part_", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    sent = asked.withColumn("of", F.pmod(F.xxhash64("ask"), F.lit(parts)).cast("int")).withColumn("on", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = dealt.groupBy("shard", "part_").cogroup(sent.groupBy("on", "of")).applyInArrow(_searching(k), "ask string, hits array<struct<id:bigint,score:double>>")
    if shards > 1:
        found = found.groupBy("ask").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    order = F.array_sort(F.transform("hits", lambda x: F.struct((-F.round(x["score"], 6)).alias("s"), x["id"].alias("id"))))
    return stored(found.select("ask", F.transform(F.slice(order, 1, k), lambda x: F.struct(x["id"].alias("id"), (-x["s"]).alias("score"))).alias("hits")), "found")


def term_search(postings: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """ask, id, score, rank: a row for each of term_lists()."""
    x = term_lists(postings, asked, k).select("ask", F.posexplode("hits").alias("place", "x"))
    return x.select("ask", "x.id", "x.score", (F.col("place") + 1).alias("rank"))
