"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints: 64 bits by majority over the XXH64 hashes of the three-word shingles. Only distinct fingerprints are
searched; documents join in again at the end, so exact copies cost nothing. Fingerprints within 3 bits agree in one of
four 16-bit blocks, and in one of four 12-bit parts of the remaining 48 bits: each is sent to the 16 keys made so, and
two that link meet under one key at least. Keys that still hold many fingerprints are dealt once more by quarters of the
36 bits left. Under a key, fingerprints are sorted by Gray rank and a binary hierarchy is built over them whose nodes
keep the bits all members share (AND and OR masks). The search walks pairs of nodes: a pair is pruned as a whole when the
fixed bits that differ exceed 3, and accepted as a whole when even the free bits cannot. Links leave a key as a star to
the smallest member of each local group, never as all pairs, and components follow by repeated minimum and pointer
jumping over staged tables.

one_of_each drops near copies: its groups are the components of all pairs with a five-word Jaccard similarity of SIMILAR
percent or more, and none of these links is lost. First the Gray-order index gives stars of close fingerprints, verified by
the whole sets of shingles. Fingerprints alone miss links, so an exact search follows for pairs that aren't in one
component yet. Shingles are put in one order, those in many documents last (document frequencies are counted over all texts; the
order decides nothing but the cost); two sets of that similarity meet in the first n - 0.8 n + 1 shingles of each. Of the keys
made so, only those matter where several components meet. Up to FEW documents under a key give all their pairs; of more, each is
first compared with the one in the middle of their fingerprints, which merges most groups of copies; keys where
components still meet are cut into parts of PART documents, and each two parts are compared whole in one task: first by the
numbers of shingles in buckets, which bound what two sets can share, then, for what may link, by products of incidence
matrices, from which only a spanning star of each component leaves.

Defined results: null and empty texts have the fingerprint zero, which links like any other; one or two words are one
shingle; repeated rows share fingerprint and component; rows without an id are members but never give the component's id
(null if all lack one); an empty table gives an empty result; other columns are ignored. In one_of_each a row is named by
its id and text (64-bit hash): rows with equal ids and different texts are judged apart, of rows with equal id and text one
stays, and a group keeps its smallest id, a null only if all are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import SEPARATORS, forget, small, staged, table, text_rows, trim
from quern.llm.pieces import filled, flat

WORDS, SEED, RADIUS = 3, 42, 3
#: A key with more distinct fingerprints is dealt again by quarters of its free bits.
DENSE = 2048
#: one_of_each: shingle size, least Jaccard similarity in percent; documents under a key that give all pairs, documents
#: and shingles of a part; document frequency from which a shingle goes last, and the most such shingles that are told apart.
COPY_WORDS, SIMILAR, FEW, PART, PART_SHINGLES, COMMON, COMMON_ROWS = 5, 80, 16, 512, 1 << 20, 24, 1_000_000
#: Shingles counted by one task.
COUNTED = 1 << 22
_SEPARATOR = np.array([chr(b) in SEPARATORS for b in range(256)])
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() changes A-Z alone
    if not words:
        return 0
    if len(words) < WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    ones, n = np.zeros(64, np.int64), len(words) - WORDS + 1
    for at in range(0, n, 65536):
        part = words[at : at + 65536 + WORDS - 1]
        h = np.array([xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in zip(part, part[1:], part[2:], strict=False)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_rows(batches):
        values = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["_id", "_fp"])


def _node_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprint, number of five-word shingles and their counts by bucket."""
    forget()
    for batch in text_rows(batches):
        values = np.array([fingerprint(x) for x in batch.column("_text").to_pylist()], dtype=np.uint64)
        h, bounds = copy_shingles(batch.column("_text"))
        counts = [bucket_counts(h[s:e]) for s, e in zip(bounds, bounds[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("node"), pa.array(values.view(np.int64)), pa.array(np.diff(bounds)), pa.array(counts, pa.binary())], ["_id", "node", "fp", "size", "buckets"])


def bucket_counts(h: np.ndarray) -> bytes:
    """How many hashes fall into each bucket by their leading bits; about four a bucket."""
    bits = max(4, (len(h) // 4).bit_length())
    return np.minimum(np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _may_be_similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, x, y) to the pairs that their bucket counts x, y don't rule out: sets share no more in a bucket than the
    smaller count. A count of 255 may be larger and rules nothing out."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            x, y = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (x, y))
            n = min(len(x), len(y))
            full = max(x.max(), y.max()) == 255
            both = int(np.minimum(x.reshape(n, -1).sum(axis=1), y.reshape(n, -1).sum(axis=1)).sum())
            keep.append(bool(full) or 100 * both >= SIMILAR * (int(x.sum()) + int(y.sum()) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the binary-reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def hierarchy(fps: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The Gray order of fps, and the AND and OR masks of the nodes over it by level, leaves first."""
    order = np.argsort(gray_rank(fps), kind="stable")
    levels = [(fps[order], fps[order])]
    while (size := len(levels[-1][0])) > 1:
        ands, ors = levels[-1]
        if size % 2:
            ands, ors = np.append(ands, ands[-1]), np.append(ors, ors[-1])
        levels.append((ands[0::2] & ands[1::2], ors[0::2] | ors[1::2]))
    return order, levels


def close_pairs(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of fingerprints within radius bits, each once, in bounded parts."""
    order, levels = hierarchy(fps)
    stack = [(len(levels) - 1, np.array([0]), np.array([0]))]
    while stack:
        level, a, b = stack.pop()
        if len(a) > 65536:
            stack += [(level, a[65536:], b[65536:])]
            a, b = a[:65536], b[:65536]
        ands, ors = levels[level]
        keep = np.bitwise_count((ands[a] & ~ors[b]) | (ands[b] & ~ors[a])) <= radius
        a, b = a[keep], b[keep]
        if level == 0:
            yield order[a[a != b]], order[b[a != b]]
            continue
        below, same = len(levels[level - 1][0]), a == b
        left = np.concatenate([2 * a, 2 * a, 2 * a + 1, (2 * a + 1)[~same]])
        right = np.concatenate([2 * b, 2 * b + 1, 2 * b + 1, (2 * b)[~same]])
        ok = (left < below) & (right < below)
        stack.append((level - 1, left[ok], right[ok]))


def local_groups(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For distinct fingerprints, the smallest position of each one's component under links of radius bits or fewer."""
    n = len(fps)
    order, levels = hierarchy(fps)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def unite(a: int, b: int) -> None:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)

    stack = [(len(levels) - 1, np.array([0]), np.array([0]))]
    while stack:
        level, a, b = stack.pop()
        if len(a) > 65536:  # bounds what is held at once
            stack += [(level, a[65536:], b[65536:])]
            a, b = a[:65536], b[:65536]
        ands, ors = levels[level]
        least = np.bitwise_count((ands[a] & ~ors[b]) | (ands[b] & ~ors[a]))
        keep = least <= radius
        a, b = a[keep], b[keep]
        most = np.bitwise_count((ors[a] | ors[b]) & ~(ands[a] & ands[b]))
        whole = most <= radius
        span = 1 << level
        if level == 0:
            for i, j in zip(a[whole & (a != b)].tolist(), b[whole & (a != b)].tolist(), strict=True):
                unite(i, j)
            continue
        for i, j in zip(a[whole].tolist(), b[whole].tolist(), strict=True):
            first = i * span
            for k in (*range(first, min(first + span, n)), *range(j * span, min(j * span + span, n))):
                unite(first, k)
        a, b = a[~whole], b[~whole]
        if not len(a):
            continue
        below = len(levels[level - 1][0])
        same = a == b
        left = np.concatenate([2 * a, 2 * a, 2 * a + 1, (2 * a + 1)[~same]])
        right = np.concatenate([2 * b, 2 * b + 1, 2 * b + 1, (2 * b)[~same]])
        ok = (left < below) & (right < below)
        left, right = left[ok], right[ok]
        if level <= 6 and len(left):  # members of one component need no more links between them
            tops = np.array([root(i) for i in range(n)]) if n < 65536 or level == 6 else None
            if tops is not None:
                step = span // 2
                low, high = _ranges(tops, step)
                done = (low[left] == high[left]) & (low[right] == high[right]) & (low[left] == low[right])
                left, right = left[~done], right[~done]
        stack.append((level - 1, left, right))
    tops = np.array([root(i) for i in range(n)])
    out = np.empty(n, np.int64)
    least = np.full(n, n)
    np.minimum.at(least, tops, order)
    out[order] = least[tops]
    return out


def _ranges(tops: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(0, len(tops), step)
    return np.minimum.reduceat(tops, at), np.maximum.reduceat(tops, at)


def _keyed():
    """key (bigint) expressions: block i of 16 bits, then part j of 12 bits of the rest."""
    fp = F.col("fp")
    keys = []
    for i in range(4):
        block = F.shiftrightunsigned(fp, 16 * i).bitwiseAND(0xFFFF)
        rest = F.shiftrightunsigned(fp, 16 * (i + 1)) if i < 3 else F.lit(0).cast("bigint")
        rest = F.shiftleft(rest, 16 * i).bitwiseOR(fp.bitwiseAND((1 << 16 * i) - 1)) if i else rest
        for j in range(4):
            part = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(0xFFF)
            left = F.shiftrightunsigned(rest, 12 * (j + 1))
            left = F.shiftleft(left, 12 * j).bitwiseOR(rest.bitwiseAND((1 << 12 * j) - 1)) if j else left
            key = F.lit((i * 4 + j) << 28).bitwiseOR(F.shiftleft(block, 12)).bitwiseOR(part)
            keys.append(F.struct(key.cast("bigint").alias("key"), left.cast("bigint").alias("rest")))
    return F.explode(F.array(*keys))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, sub, fp) sorted by key: a link from each fingerprint to the first of its local component."""
    held: list[np.ndarray] = []
    last = None

    def links() -> tuple[np.ndarray, np.ndarray]:
        fps = np.concatenate(held)
        top = local_groups(fps.view(np.uint64))
        far = top != np.arange(len(fps))
        return fps[far], fps[top[far]]

    def emit(out):
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    out: list = []
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
        fps = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(fps):
            continue
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(fps)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            key = (keys[0, s], keys[1, s])
            if key != last and held:
                if sum(map(len, held)) > 1:
                    out.append(links())
                held = []
            last = key
            held.append(fps[s:e])
        if sum(len(x[0]) for x in out) > 10_000:
            yield emit(out)
            out = []
    if held and sum(map(len, held)) > 1:
        out.append(links())
    if out:
        yield emit(out)


def links(fps: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect all within RADIUS bits of each other."""
    keyed = fps.select("fp", _keyed().alias("k")).select("fp", "k.key", "k.rest")
    dense = keyed.groupBy("key").count().filter(F.col("count") > DENSE).select(F.col("key").alias("_dense"))
    both = keyed.join(dense, keyed["key"] == dense["_dense"], "left")
    subs = F.array(*[(F.lit(q << 9).cast("bigint")).bitwiseOR(F.shiftrightunsigned("rest", 9 * q).bitwiseAND(0x1FF)) for q in range(4)])
    rows = both.select("key", F.explode(F.when(F.col("_dense").isNull(), F.array(F.lit(-1).cast("bigint"))).otherwise(subs)).alias("sub"), "fp")
    grouped = rows.repartition("key", "sub").sortWithinPartitions("key", "sub")
    return grouped.mapInArrow(_stars, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of each node's component. Rounds of taking the neighbours' minimum and of jumping
    to the label's label; each is staged in the shared folder, so neither lineage nor the driver grows."""
    both = staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "m").alias("next"))
        jump = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
        step = step.join(jump, step["next"] == jump["_node"]).select("node", "label", F.least("next", "_label").alias("next"))
        step = staged(step, "labels")
        changed = step.filter("next <> label").limit(1).count()
        labels = step.select("node", F.col("next").alias("label"))
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id of every row."""
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()
    rows = staged(slim.mapInArrow(_fingerprints, f"_id {kind}, _fp bigint"), "fingerprints")
    nodes = staged(rows.groupBy(F.col("_fp").alias("fp")).agg(F.min("_id").alias("first")), "nodes")
    labels = components(links(nodes.select("fp")))
    known = nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    firsts = known.groupBy(F.col("label").alias("_l")).agg(F.min("first").alias("component_id"))
    known = known.join(firsts, known["label"] == firsts["_l"]).select("fp", "component_id")
    out = rows.join(known, rows["_fp"] == known["fp"])
    return out.select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def copy_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text's five-word shingles (A-Z lower-cased), sorted by text and hash, and where each
    text's begin. One to four words are one shingle, and so is no word, so no text is without one."""
    data, bounds = flat(filled(texts))
    data = _FOLD[data]
    inside = ~_SEPARATOR[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = bounds[:-1][bounds[:-1] < len(data)]
    begins[heads] = inside[heads]
    kept = data[inside]
    place = np.append(np.flatnonzero(begins[inside]), len(kept)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(place) - 1, [None, pa.py_buffer(place), pa.py_buffer(kept)]).dictionary_encode()
    w = np.fromiter((xxhash.xxh64_intdigest(x, 11) for x in words.dictionary.to_pylist()), np.uint64)[words.indices.to_numpy()]
    starts = np.append(0, np.cumsum(begins))[bounds]
    n = np.diff(starts)
    h, p = np.zeros(max(0, len(w) - COPY_WORDS + 1), np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for k in range(COPY_WORDS):
        h = h * p + w[k : k + len(h)]
    many = np.maximum(n - COPY_WORDS + 1, 0)
    owner = np.repeat(np.arange(len(n)), many)
    h = h[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - starts[:-1], many)]
    few = np.flatnonzero(n < COPY_WORDS)
    short = [xxhash.xxh64_intdigest(w[starts[k] : starts[k + 1]].tobytes(), 12) for k in few.tolist()]
    owner, h = np.append(owner, few), np.append(h, np.array(short, np.uint64))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    by = np.lexsort((h, owner))
    owner, h = owner[by], h[by]
    first = np.append(True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    owner, h = owner[first], h[first]
    return h, np.searchsorted(owner, np.arange(len(n) + 1))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, text) to rows (node, its shingles)."""
    for batch in text_rows(batches):
        if batch.num_rows:
            h, bounds = copy_shingles(batch.column("_text"))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))], ["node", "made"])


def _tallying(bits: int):
    """Rows (text) to rows (bucket, the differences of sorted 32-bit shingles): 2^bits buckets by leading bits. A shingle
    stands once for each document that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        held: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            all_ = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint32)
            held.clear()
            cuts = np.searchsorted(all_, np.arange(1 << bits, dtype=np.uint64) << np.uint64(32 - bits))
            parts = [np.diff(x, prepend=np.uint32(0)).astype("<u4").tobytes() for x in np.split(all_, cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(range(1 << bits), pa.int32()), pa.array(parts, pa.binary())], ["bucket", "steps"])

        for batch in text_rows(batches):
            if batch.num_rows:
                held.append((copy_shingles(batch.column("_text"))[0] >> np.uint64(32)).astype(np.uint32))
            if sum(map(len, held)) > COUNTED:
                yield packed()
        yield packed()

    return run


def _common(rows: pa.Table) -> pa.Table:
    """shingle, df of a bucket's shingles that are in COMMON documents or more."""
    all_ = np.concatenate([np.cumsum(np.frombuffer(x, "<u4"), dtype=np.uint32) for x in rows.column("steps").to_pylist()])
    shingle, df = np.unique(all_, return_counts=True)
    often = df >= COMMON
    return pa.table({"shingle": pa.array(shingle[often].astype(np.int64)), "df": pa.array(df[often].astype(np.int64))})


def common_shingles(texts: DataFrame, n_shingles: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading 32 bits of the shingles of texts that are in many documents, sorted, with their document frequency: at
    most COMMON_ROWS, the most frequent ones. They order the search and decide no pair."""
    bits = max(4, int(np.ceil(np.log2(max(1, n_shingles / COUNTED)))))
    counted = texts.select("_text").mapInArrow(_tallying(bits), "bucket int, steps binary").groupBy("bucket").applyInArrow(_common, "shingle bigint, df bigint")
    rows = staged(counted, "common").orderBy(F.desc("df"), "shingle").limit(COMMON_ROWS).toArrow()
    shingle, df = rows.column("shingle").to_numpy().astype(np.uint32), rows.column("df").to_numpy()
    by = np.argsort(shingle)
    return shingle[by], df[by]


def _heading(common):
    """Rows (node, text) to rows (key, node, size): the first shingles of each text in the order of the search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        shingle, often = common.value
        for batch in text_rows(batches):
            if not batch.num_rows:
                continue
            h, bounds = copy_shingles(batch.column("_text"))
            size = np.diff(bounds)
            df = np.zeros(len(h), np.int64)
            if len(shingle):
                short = (h >> np.uint64(32)).astype(np.uint32)
                place = np.minimum(np.searchsorted(shingle, short), len(shingle) - 1)
                df = np.where(shingle[place] == short, often[place], 0)
            owner = np.repeat(np.arange(len(size)), size)
            h = h[np.lexsort((h, df, owner))]
            head = size - (SIMILAR * size + 99) // 100 + 1
            at = np.arange(head.sum()) - np.repeat(np.cumsum(head) - head - bounds[:-1], head)
            of = np.repeat(np.arange(len(size)), head)
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), batch.column("node").take(pa.array(of)), pa.array(size[of])], ["key", "node", "size"])

    return run


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, size) sorted by key and node to the rows of keys with several nodes; one row is held at a time."""
    held, linked = None, False
    for batch in batches:
        rows = [batch.column(k).to_numpy() for k in range(3)]
        if held is not None:
            rows = [np.append(h, r) for h, r in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        fresh = np.append(True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]))
        key, node, size = (r[fresh] for r in rows)
        same = key[1:] == key[:-1]
        out = np.append(linked, same)[:-1] | same
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1][out]) for x in (key, node, size)], ["key", "node", "size"])
        held, linked = [x[-1:] for x in (key, node, size)], bool(same[-1]) if len(same) else linked
    if held is not None and linked:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["key", "node", "size"])


def possible_links(sizes: np.ndarray, labels: np.ndarray, counts: list[np.ndarray]) -> np.ndarray:
    """Which sets may link to one of another label, by their sizes and bucket counts. Sizes that fit differ by one bit at
    most in their number of buckets, so a set is compared at its own number and folded to the half."""
    out = np.zeros(len(sizes), bool)
    width = np.array([len(c) for c in counts])
    full = np.array([c.max() == 255 for c in counts])
    for w in np.unique(width).tolist():
        own, less = np.flatnonzero(width == w), np.flatnonzero(width == w // 2)
        mine = np.stack([counts[k] for k in own]).astype(np.int32)
        folded = mine.reshape(len(own), -1, 2).sum(axis=2)
        halves = np.stack([counts[k] for k in less]).astype(np.int32) if len(less) else None
        for at, k in enumerate(own.tolist()):
            for rows, both in [(own, np.minimum(mine, mine[at]).sum(axis=1))] + ([(less, np.minimum(halves, folded[at]).sum(axis=1))] if halves is not None else []):
                ok = (labels[rows] != labels[k]) & ((100 * both >= SIMILAR * (sizes[rows] + sizes[k] - both)) | full[rows] | full[k])
                ok &= 100 * np.minimum(sizes[rows], sizes[k]) >= SIMILAR * np.maximum(sizes[rows], sizes[k])
                out[rows[ok]] = True
                out[k] |= ok.any()
    return out


def _sifting(rows: pa.Table) -> pa.Table:
    """Rows (key, lo, hi, node, size, label, buckets) of one or two parts to those that may link to another component."""
    counts = [np.frombuffer(x, np.uint8) for x in rows.column("buckets").to_pylist()]
    keep = possible_links(rows.column("size").to_numpy(), rows.column("label").to_numpy(), counts)
    return rows.select(["key", "lo", "hi", "node"]).filter(pa.array(keep))


def spanning(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the first of its component under links of SIMILAR percent, by products of the incidence matrix."""
    sizes = np.array([len(x) for x in sets])
    owner, values = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    both = np.zeros((len(sets), len(sets)), np.float32)  # whole numbers below 2^24 are exact
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        s, e = np.searchsorted(column, (at, at + 2048))
        part = np.zeros((len(sets), 2048), np.float32)
        part[owner[s:e], column[s:e] - at] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    linked = 100 * both >= SIMILAR * (sizes[:, None] + sizes[None, :] - both)
    top = np.arange(len(sets))
    while True:
        lower = np.where(linked, top[None, :], len(sets)).min(axis=1)
        lower = np.minimum(lower, top)
        lower = lower[lower]
        if (lower == top).all():
            return top
        top = lower


def _comparing(rows: pa.Table) -> pa.Table:
    """Rows (node, made) of one or two parts to links (a, b) that span the components among them."""
    nodes = rows.column("node").to_numpy()
    made = rows.column("made").combine_chunks()
    made = pa.concat_arrays(made.chunks) if isinstance(made, pa.ChunkedArray) else made
    bounds, values = made.offsets.to_numpy(), made.values.to_numpy()
    top = spanning([values[s:e] for s, e in zip(bounds, bounds[1:])])
    far = top != np.arange(len(top))
    return pa.table({"a": pa.array(nodes[far]), "b": pa.array(nodes[top[far]])})


def once(rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows (key columns, node) of one key of all that have the same nodes: copies meet under many."""
    members = rows.groupBy(*key).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.hash("node", F.lit(1)).cast("bigint")).alias("y"))
    named = members.groupBy("n", "x", "y").agg(F.min(F.struct(*key)).alias("k")).select("k.*")
    return rows.join(named, key, "left_semi")


def _sizes_fit(a: str, b: str):
    return (100 * F.least(a, b) >= SIMILAR * F.greatest(a, b))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near copies: of each group the row with the smallest id. Texts are read, never shuffled,
    while the lists of dropped rows and of compared texts are small enough to broadcast."""
    spark = docs.sparkSession
    node = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), node.alias("node"))
    kind = slim.schema["_id"].dataType.simpleString()
    rows = staged(slim.mapInArrow(_node_fingerprints, f"_id {kind}, node bigint, fp bigint, size bigint, buckets binary"), "fingerprints")
    keys = rows.groupBy("node", "_id").agg(F.count("*").alias("n"), F.first("fp").alias("fp"))
    counts = rows.select("node", "buckets").dropDuplicates(["node"])
    order = F.struct(F.col("_id").isNull().alias("null"), F.col("_id").alias("first"))
    nodes = staged(keys.groupBy("node").agg(F.min(order).alias("o"), F.first("fp").alias("fp")).select("node", "fp", "o.first"), "nodes")
    more = small(rows.join(nodes.select(F.col("node").alias("_n"), "first"), (F.col("node") == F.col("_n")) & ~F.col("_id").eqNullSafe(F.col("first"))).select("_n", F.col("_id").alias("_i")).distinct(), "more")
    single = slim.join(more, (F.col("node") == F.col("_n")) & F.col("_id").eqNullSafe(F.col("_i")), "left_anti")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """node and shingles of the wanted nodes."""
        named = small(wanted.distinct().select(F.col("node").alias("_n")), "wanted")
        texts = single.join(named, F.col("node") == F.col("_n"), "left_semi").select("node", "_text")
        return staged(texts.mapInArrow(_sets, "node bigint, made array<bigint>").dropDuplicates(["node"]), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are similar enough; most others are ruled out by their bucket counts."""
        pairs = pairs.join(counts.select(F.col("node").alias("a"), F.col("buckets").alias("x")), "a").join(counts.select(F.col("node").alias("b"), F.col("buckets").alias("y")), "b")
        pairs = staged(pairs.select("a", "b", "x", "y").mapInArrow(_may_be_similar, "a bigint, b bigint"), "possible")
        made = sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))))
        left, right = made.select(F.col("node").alias("a"), F.col("made").alias("x")), made.select(F.col("node").alias("b"), F.col("made").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        return staged(pairs.join(left, "a").join(right, "b").filter(100 * both >= SIMILAR * (F.size("x") + F.size("y") - both)).select("a", "b"), "verified")

    # close fingerprints: stars of the Gray-order index, and of the texts of one fingerprint
    of = staged(nodes.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    close = links(of.select("fp"))
    close = close.join(of.select(F.col("fp").alias("a"), F.col("head").alias("_a")), "a").join(of.select(F.col("fp").alias("b"), F.col("head").alias("_b")), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    same_fp = nodes.join(of, "fp").filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    found = verified(staged(close.union(same_fp).distinct(), "close"))
    labels = components(found)

    # an order of shingles, the first of each text, and the keys under which texts meet
    n_shingles = rows.agg(F.sum("size")).first()[0] or 0
    common = spark.sparkContext.broadcast(common_shingles(single, n_shingles))  # COMMON_ROWS at most
    heads = single.select("node", "_text").mapInArrow(_heading(common), "key bigint, node bigint, size bigint")
    met = staged(heads.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_meeting, "key bigint, node bigint, size bigint"), "meetings")
    met = staged(once(met, ["key"]), "met")

    def crossing(labels: DataFrame) -> DataFrame:
        """met rows of the keys where several components meet, with their label and the number and shingles of their key."""
        known = met.join(labels, "node", "left").select("key", "node", "size", F.coalesce("label", "node").alias("label"))
        mixed = known.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
        return known.join(mixed.select("key", "n", "shingles"), "key")

    rows_x = staged(crossing(labels), "crossing")
    few = rows_x.filter(F.col("n") <= FEW)
    left, right = (few.select("key", *[F.col(c).alias(s + c) for c in ("node", "size", "label")]) for s in "xy")
    pairs = left.join(right, "key").filter((F.col("xnode") < F.col("ynode")) & (F.col("xlabel") != F.col("ylabel")) & _sizes_fit("xsize", "ysize")).select(F.col("xnode").alias("a"), F.col("ynode").alias("b"))
    many = rows_x.filter(F.col("n") > FEW).join(nodes.select("node", "fp"), "node")
    bit = [F.sum(F.getbit("fp", F.lit(k))).alias(f"_{k}") for k in range(64)]
    middle = sum((F.when(2 * F.col(f"_{k}") > F.col("n"), F.lit(1 << k if k < 63 else -(1 << 63)).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for k in range(64)), F.lit(0).cast("bigint"))
    middles = many.groupBy("key", "n").agg(*bit).select("key", middle.alias("middle"))
    hubs = many.join(middles, "key").groupBy("key").agg(F.min_by(F.struct("node", "size", "label"), F.struct(F.bit_count(F.col("fp").bitwiseXOR(F.col("middle"))), "node")).alias("hub"))
    starred = many.join(hubs, "key").filter((F.col("label") != F.col("hub.label")) & _sizes_fit("size", "hub.size")).select(F.col("node").alias("a"), F.col("hub.node").alias("b"))
    found = found.union(verified(staged(pairs.union(starred).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")))
    labels = components(found)

    # large keys where components still meet: each two parts of it whole in one task
    left = staged(crossing(labels).filter(F.col("n") > FEW), "parts")
    if not left.isEmpty():
        parts = F.ceil(F.greatest(F.col("n") / PART, F.col("shingles") / PART_SHINGLES)).cast("int")
        dealt = left.select("key", "node", "size", "label", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"))
        dealt = dealt.select("key", "node", "size", "label", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        dealt = dealt.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "node", "size", "label").join(counts, "node")
        sifted = dealt.select("key", "lo", "hi", "node", "size", "label", "buckets").groupBy("key", "lo", "hi").applyInArrow(_sifting, "key bigint, lo int, hi int, node bigint")
        sifted = staged(once(staged(sifted, "sifted"), ["key", "lo", "hi"]), "sifted")
        compared = sifted.join(sets_of(sifted.select("node")), "node").groupBy("key", "lo", "hi").applyInArrow(_comparing, "a bigint, b bigint")
        labels = components(found.union(staged(compared.distinct(), "compared")))

    labels = labels.join(nodes, "node")
    best = labels.groupBy(F.col("label").alias("_l")).agg(F.min(F.struct(F.col("first").isNull().alias("null"), "first", "node")).alias("best"))
    lost = staged(labels.join(best, labels["label"] == best["_l"]).filter("node <> best.node").select("node"), "lost")
    keep = nodes.join(lost, "node", "left_anti")
    judged = keys.join(keep.select(F.col("node").alias("_n"), "first"), (F.col("node") == F.col("_n")) & F.col("_id").eqNullSafe(F.col("first")), "left")
    judged = staged(judged.select(F.col("node").alias("_n"), F.col("_id").alias("_i"), "n", F.col("_n").isNull().alias("gone")), "judged")
    at = "_node" + "_" * max((len(c) for c in docs.columns), default=0)  # no column of docs has this name
    named = docs.withColumn(at, node)
    same = lambda keys: (F.col(at) == keys["_n"]) & docs[id_col].eqNullSafe(keys["_i"])
    drop = small(judged.filter("gone or n > 1").select("_n", "_i"), "dropped")
    out = named.join(drop, same(drop), "left_anti")
    again = judged.filter("not gone and n > 1").select("_n", "_i")
    if not again.isEmpty():  # of repeated rows one stays
        again = small(again, "again")
        out = out.union(named.join(again, same(again), "left_semi").dropDuplicates([id_col, at]))
    return out.drop(at)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
