"""Substring dedup: suffix automata of shards of the corpus, and matching statistics against them.

A window is SPAN consecutive words of one document. Every word covered by a window that occurs anywhere else is removed.
The reference is the corpus itself, so it grows with the data and its automata can't all be broadcast: the shards are cut by
content, and what may match a shard is sent to it.

1. Each window names an anchor: its least-hashed sequence of ANCHOR words. Equal windows have equal anchors, so all
   occurrences of a window meet in the shard of its anchor. The consecutive windows of one anchor form a context.
2. Contexts are counted (equal ones collapse by partial aggregation, so a passage that a third of the documents share is
   one row), then anchors. Anchors that occur once are done with.
3. A shard holds the distinct contexts of an anchor with their counts. A generalised suffix automaton over their words is
   built, occurrence counts are summed along its suffix links, and each context is streamed through it keeping the state
   of its last SPAN words (the matching statistic, cut at the threshold): a window repeats where that state's count
   is over 1.
4. An anchor with more than DENSE distinct contexts (a common phrase in ever new surroundings) is refined: its windows
   themselves become the keys, counted by partial aggregation, which no frequency makes heavy.
5. The repeated windows go back to their documents; maximal covered spans are removed.

remove_known does the same against an outside reference, whose shards' automata are broadcast one after the other.

Words are compared as 64-bit hashes, windows and contexts by 64 bits more than that at each key.

Defined results: a null or empty text has no words and nothing is removed; documents under SPAN words are left alone;
rows that repeat remove each other's words, both of them; a window that overlaps another occurrence of itself counts as
repeated; texts of any length are taken whole; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import row_key, staged, table, text_rows

SPAN, ANCHOR, DENSE = 35, 8, 64
#: Characters of a broadcast shard of an outside reference (remove_known): some 350,000 automaton states.
SHARD_CHARS = 1_000_000
_B = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array(list(map(xxhash.xxh64_intdigest, words)), dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _B[3]
    x = x ^ (x >> np.uint64(29))
    x = x * _B[4]
    return x ^ (x >> np.uint64(32))


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all sequences of size words, from doubled ones: as many steps as size has binary digits."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, power, width, level = None, 0, h, 1, 0
    while width <= size:
        if size & width:
            part = power[done : done + n]
            out = part if out is None else _mix(out * _B[5] + part)
            done += width
        if 2 * width <= size:
            power = _mix(power[:-width] * _B[level % 3] + power[width:] + np.uint64(level))
        width, level = 2 * width, level + 1
    return _mix(out + np.uint64(size))


def contexts(h: np.ndarray, span: int = SPAN, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """start, number of windows, anchor hash and context hash of each run of windows that name one anchor."""
    empty = np.empty(0, np.int64)
    if len(h) < span:
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    keys = gram_hashes(h, anchor)
    width = span - anchor + 1
    n = len(h) - span + 1
    place = np.empty(n, np.int64)
    for s in range(0, n, 65536):
        e = min(n, s + 65536)
        view = np.lib.stride_tricks.sliding_window_view(keys[s : e + width - 1], width)
        place[s:e] = view.argmin(axis=1) + np.arange(s, e)
    cuts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    counts = np.diff(np.append(cuts, n))
    windows = gram_hashes(h, span)
    first, last = windows[cuts], windows[cuts + counts - 1]
    ctx = _mix(_mix(first) * _B[0] + last * _B[1] + counts.astype(np.uint64) * _B[2] + (place[cuts] - cuts).astype(np.uint64))
    return cuts, counts, keys[place[cuts]], ctx


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_rows(batches):
        made = [contexts(word_hashes(split_words(t))) for t in batch.column("_text").to_pylist()]
        at = pa.array(np.repeat(np.arange(len(made)), [len(m[0]) for m in made]))
        cols = [np.concatenate([m[i] for m in made]) if made else np.empty(0) for i in range(4)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_rk").take(at), batch.column("_rk2").take(at), pa.array(cols[0].astype(np.int32)), pa.array(cols[1].astype(np.int32)), pa.array(cols[2].astype(np.uint64).view(np.int64)), pa.array(cols[3].astype(np.uint64).view(np.int64))],
            ["_rk", "_rk2", "start", "n_windows", "anchor", "context"],
        )


class SuffixAutomaton:
    """Generalised suffix automaton of weighted sequences; count[s] is how often the sequences of state s occur."""

    def __init__(self):
        self.link, self.length, self.next, self.count = [-1], [0], [{}], [0]

    def add(self, sequence: list[int], weight: int) -> None:
        link, length, nexts, count = self.link, self.length, self.next, self.count
        last = 0
        for c in sequence:
            q = nexts[last].get(c)
            if q is not None:  # the sequence so far is known already
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._clone(last, q, c)
                count[last] += weight
                continue
            cur = len(link)
            link.append(0)
            length.append(length[last] + 1)
            nexts.append({})
            count.append(weight)
            p = last
            while p != -1 and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p != -1:
                q = nexts[p][c]
                link[cur] = q if length[p] + 1 == length[q] else self._clone(p, q, c)
            last = cur

    def _clone(self, p: int, q: int, c: int) -> int:
        new = len(self.link)
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.next.append(dict(self.next[q]))
        self.count.append(0)
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def close(self) -> None:
        """Sum the counts along the suffix links, longest states first."""
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]

    def occurrences(self, sequence: list[int], span: int) -> list[int]:
        """How often each window of span elements occurs: the matching statistics of sequence, cut at span."""
        state, have, out = 0, 0, []
        for i, c in enumerate(sequence):
            while state and c not in self.next[state]:
                state = self.link[state]
                have = self.length[state]
            if c in self.next[state]:
                state, have = self.next[state][c], have + 1
            while have > span or self.length[self.link[state]] >= span:
                if self.length[self.link[state]] >= span:
                    state = self.link[state]
                have = min(have, span)
                if self.length[self.link[state]] < span:
                    break
            if i >= span - 1:
                out.append(self.count[state] if have >= span else 0)
        return out


    def covered(self, sequence: list[int], span: int) -> list[tuple[int, int]]:
        """Maximal spans (start, end) of sequence made of matches of span elements or more with the automaton's sequences."""
        state, have, spans = 0, 0, []
        for i, c in enumerate(sequence):
            while state and c not in self.next[state]:
                state = self.link[state]
                have = self.length[state]
            if c in self.next[state]:
                state, have = self.next[state][c], have + 1
            if have >= span:
                start = i + 1 - have
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans


def repeated_windows(sequences: list[list[int]], weights: list[int], span: int = SPAN) -> list[int]:
    """By sequence, a bit mask of its windows that occur more than once among all of them."""
    automaton = SuffixAutomaton()
    for s, w in zip(sequences, weights, strict=True):
        automaton.add(s, w)
    automaton.close()
    return [sum(1 << i for i, n in enumerate(automaton.occurrences(s, span)) if n > 1) for s in sequences]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, context, n, words) sorted by anchor: masks of the repeated windows, shard by shard."""
    held: list[tuple[int, int, list[int]]] = []
    last, out = None, []

    def done() -> None:
        masks = repeated_windows([w for _, _, w in held], [n for _, n, _ in held])
        out.extend((last, c, m) for (c, _, _), m in zip(held, masks, strict=True) if m)

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["anchor", "context", "mask"])

    for batch in batches:
        for anchor, context, n, words in zip(*(batch.column(c).to_pylist() for c in ("anchor", "context", "n", "words")), strict=True):
            if anchor != last:
                if held:
                    done()
                held, last = [], anchor
            held.append((context, n, np.frombuffer(words, "<i8").tolist()))
        if len(out) > 4096:
            yield emit()
            out.clear()
    if held:
        done()
    yield emit()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, context, n, words): a row for each window, with two hashes of it."""
    for batch in text_rows(batches):
        h = [np.frombuffer(w, "<i8").view(np.uint64) for w in batch.column("words").to_pylist()]
        one = [gram_hashes(x, SPAN) for x in h]
        two = [gram_hashes(_mix(x + _B[2]), SPAN) for x in h]
        sizes = [len(x) for x in one]
        at = pa.array(np.repeat(np.arange(len(h)), sizes))
        flat = lambda xs: pa.array((np.concatenate(xs) if xs else np.empty(0, np.uint64)).view(np.int64))
        place = pa.array(np.concatenate([np.arange(s) for s in sizes]) if sizes else np.empty(0, np.int64), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("anchor", "context", "n")] + [place, flat(one), flat(two)], ["anchor", "context", "n", "place", "w1", "w2"])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, wanted contexts): the contexts' words as 64-bit hashes."""
    for batch in text_rows(batches, 64):
        out: list[tuple] = []
        for text, wanted in zip(batch.column("_text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            words = split_words(text)
            for w in wanted:
                h = word_hashes(words[w["start"] : w["start"] + w["n_windows"] + SPAN - 1])
                out.append((w["anchor"], w["context"], w["n"], w["dense"], h.astype("<u8").tobytes()))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["anchor", "context", "n", "dense", "words"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_rows(batches):
        kept, total, gone = [], [], []
        for text, spots in zip(batch.column("_text").to_pylist(), batch.column("spots").to_pylist(), strict=True):
            words = split_words(text)
            total.append(len(words))
            if spots:
                edge = np.zeros(len(words) + 1, np.int64)
                for s in spots:
                    mask, at = s["mask"], s["start"]
                    starts = [at + i for i in range(mask.bit_length()) if mask >> i & 1]
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, [x + SPAN for x in starts], -1)
                keep = np.cumsum(edge[:-1]) == 0
                words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            gone.append(total[-1] - len(words))
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["_id", "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept_text (the remaining words joined by one space) of every row."""
    slim = docs.select(F.col(id_col).alias("_id"), *row_key(F.col(id_col), F.col(text_col)), F.col(text_col).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()
    rows = staged(slim.mapInArrow(_anchored, "_rk bigint, _rk2 int, start int, n_windows int, anchor bigint, context bigint"), "contexts")
    one = F.struct("_rk", "_rk2", "start", "n_windows")
    counted = rows.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(one).alias("at"))
    # in the order of the columns, so that the shuffle of the next steps stays small: anchors that occur twice or more
    twice = counted.groupBy(F.col("anchor").alias("_a")).agg(F.sum("n").alias("_n"), F.count("*").alias("_m")).filter("_n > 1")
    known = staged(counted.join(twice, counted["anchor"] == twice["_a"]).select("anchor", "context", "n", "_m", "at.*"), "repeated")

    alone = known.filter("_m = 1").select("anchor", "context", F.expr("shiftleft(1L, n_windows) - 1").alias("mask"))
    wanted = known.filter("_m > 1").withColumn("dense", F.col("_m") > DENSE)
    wanted = wanted.groupBy(F.col("_rk").alias("_k"), F.col("_rk2").alias("_k2")).agg(F.collect_list(F.struct("anchor", "context", "n", "dense", "start", "n_windows")).alias("wanted"))
    texts = slim.select("_rk", "_rk2", "_text").join(wanted, (F.col("_rk") == F.col("_k")) & (F.col("_rk2") == F.col("_k2")))
    words = texts.select("_text", "wanted").mapInArrow(_fetch, "anchor bigint, context bigint, n bigint, dense boolean, words binary")
    words = staged(words, "words")
    words = words.dropDuplicates(["anchor", "context"])  # rows that repeat give their contexts twice
    sparse = words.filter(~F.col("dense")).select("anchor", "context", "n", "words")
    shards = sparse.repartition("anchor").sortWithinPartitions("anchor", "context").mapInArrow(_shards, "anchor bigint, context bigint, mask bigint")

    windows = words.filter("dense").select("anchor", "context", "n", "words").mapInArrow(_windows, "anchor bigint, context bigint, n bigint, place int, w1 bigint, w2 bigint")
    often = windows.groupBy(F.col("w1").alias("_w1"), F.col("w2").alias("_w2")).agg(F.sum("n").alias("_c")).filter("_c > 1")
    again = windows.join(often, (F.col("w1") == F.col("_w1")) & (F.col("w2") == F.col("_w2")))
    refined = again.groupBy("anchor", "context").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("mask"))

    masks = alone.union(shards).union(refined)
    masks = staged(masks.select(F.col("anchor").alias("_a"), F.col("context").alias("_c"), "mask"), "masks")
    hits = rows.join(masks, (rows["anchor"] == masks["_a"]) & (rows["context"] == masks["_c"]))
    spots = hits.groupBy(F.col("_rk").alias("_k"), F.col("_rk2").alias("_k2")).agg(F.collect_list(F.struct("start", "mask")).alias("spots"))
    joined = slim.join(spots, (slim["_rk"] == spots["_k"]) & (slim["_rk2"] == spots["_k2"]), "left")
    return joined.select("_id", "_text", "spots").mapInArrow(_removed, f"_id {kind}, n_words bigint, n_removed bigint, kept_text string").withColumnRenamed("_id", id_col)


def remove_known(docs: DataFrame, reference: DataFrame, id_col: str = "doc_id", text_col: str = "text", ref_text: str = "text", span: int = SPAN, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """id, n_words, n_removed, kept_text of every row, without the words of maximal spans of at least span words that some
    reference text holds. For a reference that docs are not part of.

    The reference's distinct texts are dealt by hash into shards of about shard_chars characters, counted beforehand. The
    suffix automaton of each shard is broadcast, and all documents are streamed past it: a pass for each shard, so this
    is for references of some shards. Null and empty texts hold nothing; repeated rows are treated alike."""
    spark = docs.sparkSession
    known = reference.select(F.col(ref_text).alias("_text")).filter("_text is not null").distinct()
    total = known.agg(F.sum(F.length("_text") + 1)).first()[0] or 0
    n_shards = max(1, -(-total // shard_chars))
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()
    spots = F.array().cast("array<struct<start:int,end:int>>")
    rows = slim.withColumn("spots", spots)
    for shard in range(n_shards):
        texts = known.filter(F.pmod(F.xxhash64("_text"), F.lit(n_shards)) == shard).collect()  # about shard_chars
        automaton = SuffixAutomaton()
        for r in texts:
            automaton.add(word_hashes(split_words(r["_text"])).tolist(), 1)
        rows = rows.mapInArrow(_matched(spark.sparkContext.broadcast(automaton), span), f"_id {kind}, _text string, spots array<struct<start:int,end:int>>")
    return rows.mapInArrow(_cut_spots, f"_id {kind}, n_words bigint, n_removed bigint, kept_text string").withColumnRenamed("_id", id_col)


def _matched(shared, span: int):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in text_rows(batches):
            spots = []
            for text, before in zip(batch.column("_text").to_pylist(), batch.column("spots").to_pylist(), strict=True):
                found = automaton.covered(word_hashes(split_words(text)).tolist(), span)
                spots.append(before + [{"start": s, "end": e} for s, e in found])
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_text"), pa.array(spots, kind)], ["_id", "_text", "spots"])

    return run


def _cut_spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_rows(batches):
        kept, total, gone = [], [], []
        for text, spots in zip(batch.column("_text").to_pylist(), batch.column("spots").to_pylist(), strict=True):
            words = split_words(text)
            keep = np.ones(len(words), bool)
            for s in spots:
                keep[s["start"] : s["end"]] = False
            total.append(len(words))
            gone.append(int((~keep).sum()))
            kept.append(b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["_id", "n_words", "n_removed", "kept_text"])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT rid, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS c FROM g) WHERE c > 1),
c AS (SELECT rid, list(DISTINCT i + k) AS gone FROM r, range(0, 35) AS t(k) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(ws, ' ')
              ELSE coalesce(array_to_string(list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda p: NOT list_contains(gone, p[2])), lambda p: p[1]), ' '), '') END) AS kept_sha256
FROM w LEFT JOIN c USING (rid)
"""
