"""Encoding with a SentencePiece model that keeps, for every piece, the bytes of the original text it stands for, and decoding.

A slice of texts is normalised as one byte buffer. The model's compiled character map is a double-array trie: at all
character starts at once the longest key is looked up, a byte deeper in every step, and matches are then taken from left to
right, so that each replaces the longest prefix of what is left. Every byte of the normalised text remembers the byte of
the original from which it came (the alignment); a put-in leading space begins where the first character that stays does. The normalised text is cut into words
where no piece of the vocabulary can reach across, each distinct word of a slice is looked up once (two generations of up
to MEMO words a worker; new ones go to the library with an identity map, as they are normalised already), and the lengths
of the pieces, looked up by id, are running ends in the normalised text; the alignment projects both ends of every piece
onto the original. Of a character that falls back to bytes, the last piece holds the whole span and the others an empty
one at its start.

decode joins the pieces' bytes by id and drops the put-in space; ids whose bytes are not UTF-8 go to the library.

Only BPE models with byte fallback and without user-defined symbols are taken, others are refused with an error.

Defined results: null and empty texts have no ids and decode to an empty text; a null list of ids decodes to null; texts are
never cut; equal rows are kept each; an empty table gives an empty one; other columns are carried along unless they
have the name of an output column, which then replaces them.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import REMEMBERED, table

MEMO, SLICE = 500_000, 3 << 20
_MARK = "▁"
_MARK_BYTES = np.frombuffer(_MARK.encode(), np.uint8)
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class CharMap:
    """A compiled character map: the size of the trie in bytes, its units, then the replacements, each ended by a NUL."""

    def __init__(self, blob: bytes):
        blob = blob or bytes(4)
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64)
        self.strings = blob[4 + size :]

    def longest(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length in bytes (0: no key) and value of the longest key that begins at each start."""
        length, value = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        if not len(self.units):
            return length, value
        offset = (self.units >> 10) << ((self.units & 512) >> 6)
        label, leaf = self.units & 0x800000FF, (self.units >> 8) & 1
        alive, depth = np.arange(len(starts)), 0
        node = np.full(len(starts), offset[0])
        while True:
            inside = starts[alive] + depth < len(data)
            alive, node = alive[inside], node[inside]
            byte = data[starts[alive] + depth].astype(np.int64)
            node = node ^ byte
            fits = (byte > 0) & (node < len(self.units))
            fits[fits] = label[node[fits]] == byte[fits]
            alive, node = alive[fits], node[fits]
            if not len(alive):
                return length, value
            depth += 1
            node_offset = node ^ offset[node]
            ends = leaf[node] == 1
            length[alive[ends]] = depth
            value[alive[ends]] = self.units[node_offset[ends]] & 0x7FFFFFFF
            node = node_offset

    def replacement(self, value: int) -> bytes:
        return self.strings[value : self.strings.index(b"\0", value)]

    def apply(self, data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The mapped bytes, and for each the place in data of the character or key it came from. No key reaches over a
        place of firsts (where texts begin)."""
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        width = np.diff(starts, append=len(data))
        length, value = self.longest(data, starts)
        hits = np.flatnonzero(length)
        if not len(hits):
            return data, np.repeat(starts, width)
        limits = np.append(firsts, len(data))
        parts, came, at = [], [], 0
        origin = np.repeat(starts, width)
        for k in hits.tolist():
            begin = int(starts[k])
            if begin < at:  # inside a key that was taken
                continue
            size = int(length[k])
            limit = int(limits[np.searchsorted(limits, begin, "right")])
            if begin + size > limit:  # the longest key would run into the next text
                size, new = self._within(data[begin:limit])
                if not size:
                    continue
            else:
                new = self.replacement(int(value[k]))
            parts += [data[at:begin], np.frombuffer(new, np.uint8)]
            came += [origin[at:begin], np.full(len(new), begin)]
            at = begin + size
        return np.concatenate([*parts, data[at:]]), np.concatenate([*came, origin[at:]])

    def _within(self, data: np.ndarray) -> tuple[int, bytes]:
        length, value = self.longest(data, np.zeros(1, np.int64))
        return int(length[0]), self.replacement(int(value[0])) if length[0] else b""


class Pieces:
    """A model: normaliser, vocabulary and the library's processor for words that are normalised already."""

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        model.ParseFromString(proto)
        kinds = np.array([p.type for p in model.pieces])
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or not (kinds == BYTE).any() or (kinds == USER_DEFINED).any() or model.trainer_spec.treat_whitespace_as_suffix or not model.normalizer_spec.escape_whitespaces:
            raise ValueError("only BPE models with byte fallback, without user-defined symbols and with spaces as prefixes")
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.prefix, self.squeeze = model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces
        self.charmap = CharMap(model.normalizer_spec.precompiled_charsmap)
        texts = [p.piece for p in model.pieces]
        self.is_byte = kinds == BYTE
        raw = [bytes([int(t[3:-1], 16)]) if k == BYTE else t.encode() for t, k in zip(texts, kinds, strict=True)]
        #: Bytes of a piece in the normalised text, and in a decoded one.
        self.lengths = np.array([len(r) for r in raw], np.int64)
        said = [b"" if k == CONTROL else model.trainer_spec.unk_surface.encode() if k == UNKNOWN else r if k == BYTE else r.replace(_MARK.encode(), b" ") for r, k in zip(raw, kinds, strict=True)]
        said += [s.removeprefix(b" ") for s in said]  # ids of a second form, for the first piece of a text
        self.said = pa.array(said, pa.large_binary())
        self.said_lengths = np.array([len(s) for s in said], np.int64)
        self.marked = np.array([t.startswith(_MARK) for t in texts])
        self.size = len(texts)
        plain = [t for t, k in zip(texts, kinds, strict=True) if k == NORMAL]
        inner = "".join(t.lstrip(_MARK) for t in plain)
        self.cut_mark, self.cut_line = _MARK not in inner, not any("\n" in t and len(t) > 1 for t in plain)
        spec = model.normalizer_spec
        spec.name, spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = "identity", b"", False, False, False
        self.words = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def normalise(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normalised bytes of all texts, where each text begins in them (and the end), and for each byte (and the end of
        each text) the place in its original text: the alignment of a text has one entry more than it has bytes."""
        data, origin = flat(texts)
        data, came = self.charmap.apply(data, origin[:-1])
        bounds = np.searchsorted(came, origin)  # where texts begin in the mapped bytes
        came = came - np.repeat(origin[:-1], np.diff(bounds))
        ends = np.diff(origin)
        if self.squeeze:
            keep, ends = _squeezed(data, bounds, came, ends)
            filled = np.diff(kept := np.append(0, np.cumsum(keep))[bounds]) > 0
            data, came = data[keep], came[keep]
        else:
            kept, filled = bounds, ends > 0
        filled = filled & self.prefix
        at = kept[:-1][filled]  # a space put in before each text that isn't empty
        first = np.append(came, 0)[at] if self.squeeze else 0
        data, came = np.insert(data, at, 32), np.insert(came, at, first)
        # spaces become marks of three bytes
        width = np.where(data == 32, 3, 1)
        begin = np.append(0, np.cumsum(width))
        out, came = np.repeat(data, width), np.repeat(came, width)
        spaces = np.flatnonzero(data == 32)
        out[(begin[spaces][:, None] + np.arange(3)).ravel()] = np.tile(_MARK_BYTES, len(spaces))
        bounds = begin[kept + np.append(0, np.cumsum(filled))]
        came = np.insert(came, bounds[1:], ends)
        return out, bounds, came

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, where each text begins in them (and the end), and begin and end of each piece in its text."""
        data, bounds, came = self.normalise(texts)
        ids, starts = self._ids(data, bounds)
        sizes = np.diff(starts)
        ends = np.cumsum(self.lengths[ids])
        shift = np.repeat(np.arange(len(sizes)), sizes)  # each text's alignment has one entry more
        begin, end = came[ends - self.lengths[ids] + shift], came[ends + shift]
        loose = np.flatnonzero(self.is_byte[ids])
        if len(loose):  # bytes of one character share their origin; the end of the last is that of the character
            tail = (data[np.minimum(ends[loose], len(data) - 1)] & 0xC0) != 0x80
            tail |= ends[loose] == len(data)
            end[loose[~tail]] = begin[loose[~tail]]
        return ids, starts, begin, end

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text begins in them (and the end)."""
        return self._ids(*self.normalise(texts)[:2])

    def _ids(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
        cut = np.zeros(len(data) + 1, bool)
        cut[bounds] = True
        if self.cut_mark:
            mark = np.zeros(len(data) + 3, bool)
            mark[3:-2] = (data[:-2] == _MARK_BYTES[0]) & (data[1:-1] == _MARK_BYTES[1]) & (data[2:] == _MARK_BYTES[2]) if len(data) > 2 else False
            cut[: len(data)] |= mark[3:] & ~mark[:-3]
        if self.cut_line:
            line = np.flatnonzero(data == 10)
            cut[line] = True
            cut[line + 1] = True
        places = np.flatnonzero(cut)
        words = pa.Array.from_buffers(pa.large_string(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        codes = pa.array(self._codes(words.dictionary.to_pylist()), pa.large_binary()).take(words.indices)
        ends = np.frombuffer(codes.buffers()[1], np.int64)[codes.offset :][: len(codes) + 1]
        ids = np.frombuffer(codes.buffers()[2] or b"", "<u2" if self.size <= 1 << 16 else "<u4")
        ids = ids[ends[0] // ids.itemsize : ends[-1] // ids.itemsize].astype(np.int64)
        word_of = np.searchsorted(places, bounds)
        return ids, (ends[word_of] - ends[0]) // (2 if self.size <= 1 << 16 else 4)

    def _codes(self, words: list[str]) -> list[bytes]:
        if len(self.memo) > MEMO:  # two generations: what is in use moves on
            self.old, self.memo = self.memo, {}
        memo, old = self.memo, self.old
        found = list(map(memo.get, words))
        places = [k for k, x in enumerate(found) if x is None]
        new = []
        for k in places:
            w = words[k]
            if w in old:
                found[k] = memo[w] = old[w]
            else:
                new.append(k)
        kind = "<u2" if self.size <= 1 << 16 else "<u4"
        step = np.dtype(kind).itemsize
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            got = self.words.encode([words[k] for k in some], num_threads=1)
            flat, place = np.fromiter(chain.from_iterable(got), kind).tobytes(), 0
            for k, ids in zip(some, got, strict=True):
                found[k] = memo[words[k]] = flat[place : place + step * len(ids)]
                place += step * len(ids)
        return found

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> pa.Array:
        """The text of each list of ids."""
        sizes = np.diff(starts)
        full = sizes > 0
        odd = np.zeros(len(sizes), bool)
        first = starts[:-1][full]
        ids_as = ids
        if self.squeeze:
            odd[full] = True
        elif self.prefix:  # the put-in space: the first piece's second form is without it
            odd[full] = ~self.marked[ids[first]]
            ids_as = ids.copy()
            ids_as[first] += self.size * self.marked[ids[first]]
        raw = self.said.take(pa.array(ids_as)).buffers()[2]
        bounds = np.append(0, np.cumsum(self.said_lengths[ids_as]))[starts]
        out = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds.astype(np.int64)), raw or pa.py_buffer(b"")])
        try:
            text = out.cast(pa.large_string())
        except pa.ArrowInvalid:
            text, odd = None, odd | np.array([not _is_utf8(x) for x in out.to_pylist()])
        if odd.any():
            some = self.whole.decode([ids[starts[k] : starts[k + 1]].tolist() for k in np.flatnonzero(odd).tolist()], num_threads=1)
            rest = iter(some)
            text = pa.array([next(rest) if o else x.decode() for o, x in zip(odd.tolist(), out.to_pylist(), strict=True)], pa.large_string())
        return text


def _squeezed(data: np.ndarray, bounds: np.ndarray, came: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes stay when spaces are dropped that begin or end a text or follow another, and the end of each text's
    alignment: where the dropped spaces at its end began."""
    space = data == 32
    sizes = np.diff(bounds)
    first = np.zeros(len(data), bool)
    first[bounds[:-1][sizes > 0]] = True
    before = np.zeros(len(data), bool)
    before[1:] = space[:-1] & ~first[1:]
    lead = np.cumsum(~space) - np.repeat(np.append(0, np.cumsum(~space))[bounds[:-1]], sizes) == 0
    keep = ~(space & (before | lead))
    ends = ends.copy()
    last = np.append(data, 0)[bounds[1:] - 1]
    for k in np.flatnonzero((sizes > 0) & ((last == 32) | (last == _MARK_BYTES[2]))).tolist():
        text = data[bounds[k] : bounds[k + 1]].tobytes()
        while (shorter := text.rstrip(b" ").removesuffix(_MARK.encode())) != text:
            text = shorter
        begin = int(bounds[k]) + len(text)
        if begin < bounds[k + 1]:
            keep[begin : bounds[k + 1]] = False
            ends[k] = came[begin]
    return keep, ends


def _is_utf8(raw: bytes) -> bool:
    try:
        raw.decode()
        return True
    except UnicodeDecodeError:
        return False


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string array and the bounds of its rows in them."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


@functools.cache
def shared_pieces(path: str) -> Pieces:
    """One model a Python worker: tasks that follow each other there find the memo filled."""
    return Pieces(path)


REMEMBERED.append(shared_pieces.cache_clear)


def text_slices(batches: Iterator[pa.RecordBatch], text_col: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes of text, of one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
        groups = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            if e > s:
                yield batch.slice(s, e - s)


def filled(texts: pa.Array) -> pa.Array:
    return pc.fill_null(texts.cast(pa.large_string()), "")


def _with(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = {n: batch.column(n) for n in batch.schema.names if n not in new}
    return pa.RecordBatch.from_arrays([*kept.values(), *new.values()], [*kept, *new])


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.astype(np.int32)))


def _encoding(model: str, text_col: str, keep_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared_pieces(model)
        for batch in text_slices(batches, text_col):
            ids, starts, begin, end = pieces.encode(filled(batch.column(text_col)))
            new = {"ids": _lists(ids, starts), "begins": _lists(begin, starts), "ends": _lists(end, starts)}
            yield _with(batch if keep_text else batch.drop_columns([text_col]), new)

    return run


def _decoding(model: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared_pieces(model)
        for batch in batches:
            lists = batch.column("ids")
            starts = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))).astype(np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            texts = pieces.decode(ids, starts).cast(pa.string())
            yield _with(batch, {"decoded": pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string())) if lists.null_count else texts})

    return run


_ENCODED = [T.StructField(n, T.ArrayType(T.IntegerType(), False)) for n in ("ids", "begins", "ends")]
_DECODED = [T.StructField("decoded", T.StringType())]


def _schema(df: DataFrame, new: list[T.StructField], without: str | None = None) -> T.StructType:
    names = {f.name for f in new} | {without}
    return T.StructType([f for f in df.schema.fields if f.name not in names] + new)


def encode(docs: DataFrame, model: str | None = None, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with ids, and for each id begins and ends: the bytes of the original text (UTF-8) that its piece stands for."""
    return docs.mapInArrow(_encoding(model or default_model(), text_col, keep_text), _schema(docs, _ENCODED, None if keep_text else text_col))


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """encoded (with a column ids) with the column decoded, the text of the ids."""
    return encoded.mapInArrow(_decoding(model or default_model()), _schema(encoded, _DECODED))


def round_trip(docs: DataFrame, model: str | None = None, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """decode(encode(docs)) within one pass through the Python workers."""
    model = model or default_model()
    there, back = _encoding(model, text_col, keep_text), _decoding(model)
    return docs.mapInArrow(lambda batches: back(there(batches)), _schema(docs, [*_ENCODED, *_DECODED], None if keep_text else text_col))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = round_trip(docs, keep_text=False)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("n_bytes"),
    )
