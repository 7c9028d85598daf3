"""Tokens of one tokenizer matched with those of another by their byte ranges.

Both tokenizers cut the same bytes (a space and the text), so a token list is a list of ends that rises to the same total.
Where both lists have an end, a group of tokens closes. The common ends come from a galloping intersection: the shorter list
drives, and each of its ends is looked for in the longer one from the place of a smaller end, in steps that double until
they pass it, then by halving. Ends are looked up in rounds, every 2^k-th first, so that a round's searches start from the
places found in the round before and run in step as arrays; most need one or two probes. The common indices slice both
lists into groups, and the differences of an end's rank to that of the end before give the range of tokens that a token
overlaps: a group of p and q tokens has p + q - 1 such links.

The corpus-wide number of links of a pair of ids is gathered by blocks. A task numbers the pairs of each block of about
BLOCK bytes of text, writes documents with the numbers of their links, and the block's list of pairs with counts; lists
are summed over all blocks by pair, and each block gets the sums of its own pairs back, a row a pair and block, whatever the
number of documents that hold it. So a frequent pair has as many rows as there are blocks.

Defined results: null and empty texts, and texts that one of the tokenizers doesn't give back byte by byte (a U+2581, which the
piece model makes a space), have no tokens: zeros and '' for the groups. Texts are never cut; repeated rows and ids
give a row each; an empty table gives an empty one; columns beside id and text are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import staged, table
from quern.llm.pieces import Pieces, default_model, filled, shared_pieces, text_slices
from quern.llm.tokens import Encoder, default_tokenizer, shared_encoder

SLICE, BLOCK = 2 << 20, 24 << 20


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each value of short the number of values of long below it; both rise strictly."""
    n, m = len(short), len(long)
    rank = np.zeros(n, np.int64)
    if not n:
        return rank
    step = 1 << max(0, (n - 1).bit_length())
    while step:
        at = np.arange(step - 1, n, 2 * step)
        if len(at):
            x = short[at]
            low = np.where(at >= step, rank[np.maximum(at - step, 0)], 0)  # all of long below low is below x
            jump, alive = np.ones(len(at), np.int64), np.arange(len(at))
            while len(alive):  # double the jump while it lands on a smaller end
                probe = low[alive] + jump[alive] - 1
                inside = probe < m
                smaller = inside.copy()
                smaller[inside] = long[probe[inside]] < x[alive[inside]]
                alive = alive[smaller]
                low[alive] += jump[alive]
                jump[alive] *= 2
            high = np.minimum(low + jump - 1, m)
            open_ = np.flatnonzero(low < high)
            while len(open_):  # halve what lies between
                mid = (low[open_] + high[open_]) // 2
                smaller = long[mid] < x[open_]
                low[open_[smaller]] = mid[smaller] + 1
                high[open_[~smaller]] = mid[~smaller]
                open_ = open_[low[open_] < high[open_]]
            rank[at] = low
        step //= 2
    return rank


class Matched:
    """Common ends, groups and links of two lists of ends over the same bytes."""

    def __init__(self, ends_a: np.ndarray, ends_b: np.ndarray):
        swap = len(ends_b) < len(ends_a)
        short, long = (ends_b, ends_a) if swap else (ends_a, ends_b)
        below = gallop(short, long)
        equal = long[np.minimum(below, len(long) - 1)] == short if len(long) else np.zeros(0, bool)
        first = np.append(0, (below + equal)[:-1]) if len(short) else below  # rank of the end before
        size = below - first + 1
        mine = np.repeat(np.arange(len(short)), size)
        other = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - first, size)
        in_short, in_long = np.flatnonzero(equal), below[equal]
        self.links_a, self.links_b = (other, mine) if swap else (mine, other)
        #: Index of the last token of each group.
        self.cuts_a, self.cuts_b = (in_long, in_short) if swap else (in_short, in_long)


@functools.cache
def _letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers, the bytes of all their tokens and the decimal forms for the list of groups."""

    def __init__(self, a_path: str, b_path: str):
        self.a: Encoder = shared_encoder(a_path, True)
        self.b: Pieces = shared_pieces(b_path)
        letters = _letters()
        vocab = self.a.tokenizer.get_vocab(with_added_tokens=True)
        names = [""] * (max(vocab.values()) + 1)
        for t, k in vocab.items():
            names[k] = t
        added = {x["id"] for x in json.loads(self.a.tokenizer.to_str())["added_tokens"]}
        raw = [t.encode() if k in added else bytes(letters[c] for c in t) for k, t in enumerate(names)]
        self.a_said, self.a_lengths = pa.array(raw, pa.large_binary()), np.array([len(r) for r in raw], np.int64)
        self.b_said, self.b_lengths = self.b.said, self.b.said_lengths[: self.b.size]
        self.size_b = self.b.size
        #: Decimal ids with what follows: , or | for the first tokenizer, , or ; for the second.
        forms = [f"{k}{s}" for k in range(len(raw)) for s in ",|"] + [f"{k}{s}" for k in range(self.size_b) for s in ",;"]
        self.forms, self.form_lengths, self.form_b = pa.array(forms, pa.large_binary()), np.array([len(f) for f in forms], np.int64), 2 * len(raw)

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both tokenizers and where each text begins in them; texts that don't come back have none."""
        texts = filled(texts)
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        coded = self.a.encode(spaced)
        at = np.frombuffer(coded.buffers()[1], np.int64)[coded.offset :][: len(coded) + 1]
        ids_a = np.frombuffer(coded.buffers()[2] or b"", self.a.dtype)
        step = ids_a.itemsize
        ids_a = ids_a[at[0] // step : at[-1] // step].astype(np.int64)
        starts_a = (at - at[0]) // step
        ids_b, starts_b = self.b.ids(texts)
        good = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) & same_bytes(spaced, self.a_said, self.a_lengths, ids_a, starts_a) & same_bytes(spaced, self.b_said, self.b_lengths, ids_b, starts_b)
        if not good.all():
            ids_a, starts_a = _only(ids_a, starts_a, good)
            ids_b, starts_b = _only(ids_b, starts_b, good)
        return ids_a, starts_a, ids_b, starts_b

    def groups(self, ids_a: np.ndarray, ids_b: np.ndarray, m: Matched, starts_a: np.ndarray, starts_b: np.ndarray) -> list[str]:
        """Digest of each text's groups, a1,a2|b1;a3|b2,b3, or '' for a text without tokens."""
        last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        last_a[m.cuts_a], last_b[m.cuts_b] = 1, 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        until_a, until_b = m.cuts_a + 1, np.append(0, m.cuts_b + 1)
        form = np.empty(len(ids_a) + len(ids_b), np.int64)
        form[np.arange(len(ids_a)) + until_b[group_a]] = 2 * ids_a + last_a
        form[np.arange(len(ids_b)) + until_a[group_b]] = self.form_b + 2 * ids_b + last_b
        raw = memoryview(self.forms.take(pa.array(form)).buffers()[2] or b"")
        ends = np.append(0, np.cumsum(self.form_lengths[form]))[starts_a + starts_b].tolist()
        return [hashlib.sha256(raw[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(ends, ends[1:])]


def same_bytes(texts: pa.Array, said: pa.Array, lengths: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether the joined bytes of each text's tokens are the text's."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    joined = np.append(0, np.cumsum(lengths[ids]))[starts]
    raw = np.frombuffer(said.take(pa.array(ids)).buffers()[2] or b"", np.uint8)
    bounds = bounds - bounds[0]
    if np.array_equal(bounds, joined):
        wrong = np.append(0, np.cumsum(data != raw[: len(data)]))
        return wrong[bounds[1:]] == wrong[bounds[:-1]]
    return np.array([np.array_equal(data[s:e], raw[x:y]) for s, e, x, y in zip(bounds, bounds[1:], joined, joined[1:])])


def _only(ids: np.ndarray, starts: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(starts)
    return ids[np.repeat(good, sizes)], np.append(0, np.cumsum(sizes * good))


@functools.cache
def shared_pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


class Block:
    """Numbers of the pairs seen in a block, by first appearance, and how many links hold each."""

    def __init__(self):
        self.name, self.codes, self.order, self.counts, self.bytes = uuid.uuid4().hex, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def number(self, codes: np.ndarray) -> np.ndarray:
        seen = pa.array(codes).dictionary_encode()
        some, index = seen.dictionary.to_numpy(), seen.indices.to_numpy()
        place = np.searchsorted(self.codes, some)
        known = place < len(self.codes)
        known[known] = self.codes[place[known]] == some[known]
        numbers = np.empty(len(some), np.int64)
        numbers[known] = self.order[place[known]]
        new = np.flatnonzero(~known)
        numbers[new] = len(self.counts) + np.arange(len(new))
        self.counts = np.append(self.counts, np.zeros(len(new), np.int64))
        self.counts[numbers] += np.bincount(index, minlength=len(some))
        codes, order = np.append(self.codes, some[new]), np.append(self.order, numbers[new])
        by = np.argsort(codes, kind="stable")
        self.codes, self.order = codes[by], order[by]
        return numbers[index]

    def rows(self, schema: pa.Schema, size_b: int) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.codes), 1 << 16):
            codes, order = self.codes[at : at + (1 << 16)], self.order[at : at + (1 << 16)]
            have = {"block": pa.array([self.name] * len(codes)), "pair": pa.array(order), "a": pa.array((codes // size_b).astype(np.int32)), "b": pa.array((codes % size_b).astype(np.int32)), "n": pa.array(self.counts[order])}
            yield pa.RecordBatch.from_arrays([have.get(f.name, pa.nulls(len(codes), f.type)) for f in schema], schema=schema)


def _linking(a_path: str, b_path: str, id_type: pa.DataType) -> Callable:
    schema = pa.schema([("block", pa.string()), ("id", id_type), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("steps", pa.binary()), ("times", pa.binary()), ("pair", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, block = shared_pair(a_path, b_path), Block()
        for batch in text_slices(batches, "_text", SLICE):
            ids_a, starts_a, ids_b, starts_b = pair.tokens(batch.column("_text"))
            m = Matched(np.cumsum(pair.a_lengths[ids_a]), np.cumsum(pair.b_lengths[ids_b]))
            numbers = block.number(ids_a[m.links_a] * pair.size_b + ids_b[m.links_b])
            rows = batch.num_rows
            n_a, n_b = np.diff(starts_a), np.diff(starts_b)
            n_groups = np.diff(np.searchsorted(m.cuts_a, starts_a))
            n_links = n_a + n_b - n_groups
            # a document's pairs in rising order, as steps, and how often each occurs
            keys, times = np.unique((np.repeat(np.arange(rows), n_links) << 40) | numbers, return_counts=True)
            owner, number = keys >> 40, keys & ((1 << 40) - 1)
            first = np.append(True, owner[1:] != owner[:-1]) if len(owner) else np.zeros(0, bool)
            steps = np.where(first, number, number - np.append(0, number[:-1])).astype("<u4")
            bounds = (4 * np.searchsorted(owner, np.arange(rows + 1))).astype(np.int32)
            binary = lambda x: pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(bounds), pa.py_buffer(x.astype("<u4"))])  # noqa: E731, B023
            have = {"block": pa.array([block.name] * rows), "id": batch.column("_id"), "n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(n_groups), "n_links": pa.array(n_links), "groups_sha256": pa.array(pair.groups(ids_a, ids_b, m, starts_a, starts_b)), "steps": binary(steps), "times": binary(times)}
            yield pa.RecordBatch.from_arrays([have.get(f.name, pa.nulls(rows, f.type)) for f in schema], schema=schema)
            block.bytes += batch.nbytes
            if block.bytes >= BLOCK:
                yield from block.rows(schema, pair.size_b)
                block = Block()
        yield from block.rows(schema, pair.size_b)

    return run


def _add_up(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """n_best and count_sum of a block's documents from the corpus-wide counts of its pairs."""
    order = np.argsort(pairs.column("pair").to_numpy())
    total, best = pairs.column("total").to_numpy()[order], pairs.column("best").to_numpy()[order]
    docs = docs.combine_chunks()
    read = lambda name: np.frombuffer(b"".join(docs.column(name).to_pylist()), "<u4").astype(np.int64)
    steps, times = read("steps"), read("times")
    ends = np.append(0, np.cumsum(pc.binary_length(docs.column("steps")).to_numpy())) // 4
    number = np.cumsum(steps)
    before = np.append(0, number)[ends[:-1]]
    number = number - np.repeat(before, np.diff(ends))
    add = lambda x: np.diff(np.append(0, np.cumsum(x))[ends])
    out = {n: docs.column(n) for n in ("id", "n_a", "n_b", "n_groups", "n_links")}
    out |= {"n_best": pa.array(add(times * best[number])), "count_sum": pa.array(add(times * total[number])), "groups_sha256": docs.column("groups_sha256")}
    return pa.table(out)


_ROW = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint"


def link_tokens(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Staged documents with their numbered links, and staged pairs (a, b, total over the corpus, best of its b), a row a pair
    and block."""
    a_path, b_path = a_path or default_tokenizer(), b_path or default_model()
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = slim.schema["_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"block string, id {kind.simpleString()}, {_ROW}, groups_sha256 string, steps binary, times binary, pair bigint, a int, b int, n bigint"
    both = staged(slim.mapInArrow(_linking(a_path, b_path, to_arrow_type(kind)), schema), "links")
    listed = both.filter("pair is not null").select("block", "pair", "a", "b", "n")
    totals = staged(listed.groupBy("a", "b").agg(F.sum("n").alias("total")), "pair-counts")
    highest = totals.groupBy("b").agg(F.max("total").alias("highest"))  # a row for each id of the second vocabulary at most
    known = totals.join(F.broadcast(highest), "b").select("a", "b", "total", (F.col("total") == F.col("highest")).cast("bigint").alias("best"))
    pairs = listed.join(known, ["a", "b"]).select("block", "pair", "a", "b", "total", "best")
    return both.filter("pair is null").select("block", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "steps", "times"), pairs


def cross_tokenizer(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document the number of tokens, groups and links, the links that are the most frequent of their second id
    (n_best), the sum of all links' corpus-wide counts, and the digest of its groups."""
    linked, pairs = link_tokens(docs, a_path, b_path, id_col, text_col)
    kind = linked.schema["id"].dataType.simpleString()
    sums = linked.groupBy("block").cogroup(pairs.select(F.col("block").alias("of"), "pair", "total", "best").groupBy("of")).applyInArrow(_add_up, f"id {kind}, {_ROW}, n_best bigint, count_sum bigint, groups_sha256 string")
    return sums.withColumnRenamed("id", id_col)


def _aligning(a_path: str, b_path: str) -> Callable:
    def lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = shared_pair(a_path, b_path)
        for batch in text_slices(batches, "_text", SLICE):
            ids_a, starts_a, ids_b, starts_b = pair.tokens(batch.column("_text"))
            m = Matched(np.cumsum(pair.a_lengths[ids_a]), np.cumsum(pair.b_lengths[ids_b]))
            at = np.searchsorted(m.cuts_a, starts_a)
            cut = lambda cuts, starts: lists(cuts + 1 - np.repeat(starts[:-1], np.diff(at)), at)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([batch.column("_id"), lists(ids_a, starts_a), lists(ids_b, starts_b), cut(m.cuts_a, starts_a), cut(m.cuts_b, starts_b)], ["id", "a_ids", "b_ids", "a_cuts", "b_cuts"])

    return run


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, a_ids, b_ids, and for each group the number of tokens of either list up to its end (a_cuts, b_cuts)."""
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()
    schema = f"id {kind}, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>"
    return slim.mapInArrow(_aligning(a_path or default_tokenizer(), b_path or default_model()), schema).withColumnRenamed("id", id_col)


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokenizer(table(spark, sf_dir, "documents"))
