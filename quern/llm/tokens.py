"""Token ids in bit- or byte-plane files.

Documents are encoded with a tokenizer of the tokenizers library and an end id, ordered by document id, and written as
files of the shared folder. A file holds chunks of at most CHUNK ids: each chunk is transposed into planes (byte k of all
ids, or bit k of all ids), each plane is compressed with zstandard alone, and a footer keeps the index of the chunks
(offset, number of ids, sizes of the planes) and of the documents. Planes of high bytes are nearly constant and vanish.

Encoding works on pieces: the text is cut before spaces and around line ends, where the byte-level pre-tokenizer always
begins a new pre-token, so the ids of the pieces are the ids of the text. Each distinct piece of a slice is looked up once;
its ids are remembered (two generations of up to MEMO pieces a worker), and unknown pieces go to the library in batches.

Defined results: a null text counts as empty and has the end id alone; texts are never cut; rows are ordered by id, nulls
first, rows with equal ids by a hash of their tokens; repeated rows are written each; an empty table writes no file and gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import REMEMBERED, new_dir, staged, table, text_rows, trim

CHUNK, MEMO = 1 << 16, 600_000
MAGIC = b"QPLANES1"
_CUT = re.compile(r"(?<=\S)(?= \S)")
_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Texts that the column-wise cut leaves to _CUT: three white characters in a row, two at the end, a NUL, special tokens.
_ODD = rf"{_SPACE}{_SPACE}(?:{_SPACE}|\z)|\x00|<\|"
_MARKS = ".,;:!?%$&*#|"
SLICE = 8 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts as little-endian bytes (2 an id if the vocabulary fits, else 4), with a memo of pieces. plain:
    names of special tokens within a text are ordinary text. Tokenizers that aren't byte-level are refused."""

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        setting = json.loads(self.tokenizer.to_str())
        cutter = setting["pre_tokenizer"] or {}
        if cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or setting["normalizer"]:
            raise ValueError(f"{path}: only byte-level tokenizers without a normalizer and a prefix space, whose pieces can be cut at spaces")
        self.tokenizer.encode_special_tokens = plain
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        ends = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_end = ends[0] if len(ends) == 1 else None

    def _ids(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def _learn(self, new: list[str]) -> None:
        """Pieces without inner white space go to the library as the lines of one text (a line end is a token of its own
        between them), the others one by one."""
        memo = self.memo
        plain = [p for p in new if len(p.split()) == 1 and "<|" not in p and not p[-1].isspace()] if self.line_end is not None else []
        for at in range(0, len(plain), 8192):
            some = plain[at : at + 8192]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            cuts = np.flatnonzero(ids == self.line_end).tolist()
            if len(cuts) == len(some) - 1:
                size, data = ids.itemsize, ids.tobytes()
                for name, s, e in zip(some, [0, *[c + 1 for c in cuts]], [*cuts, len(ids)], strict=True):
                    memo[name] = data[s * size : e * size]
        for p in new:
            if p not in memo:
                memo[p] = self._ids(self.tokenizer.encode(p, add_special_tokens=False).ids)

    def _codes(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces. A letter and the punctuation after it never share a pre-token, so only the word and
        the punctuation of such a piece are remembered."""
        if len(self.memo) > MEMO:  # two generations: what is in use moves on
            self.old, self.memo = self.memo, {}
        memo, old = self.memo, self.old
        ends, missing = {}, set()
        for p in pieces:
            word = p.rstrip(_MARKS)
            if len(word) != len(p) and word and word[-1].isalpha() and word[-1] < "\u0250":
                ends[p] = (word, p[len(word) :])
                parts = ends[p]
            else:
                parts = (p,)
            for x in parts:
                if x not in memo:
                    if x in old:
                        memo[x] = old[x]
                    else:
                        missing.add(x)
        self._learn(list(missing))
        return [memo[ends[p][0]] + memo[ends[p][1]] if p in ends else memo[p] for p in pieces]

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of each text (null: none). Texts with odd white space are cut one by one, all others as a column."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, _ODD)
        marked = pc.replace_substring(pc.replace_substring(texts.filter(pc.invert(odd)), " ", "\0 "), "\n", "\0\n\0")
        out = [self._join(pc.split_pattern(marked, "\0"))]
        strange = texts.filter(odd)
        if len(strange):
            out.append(self._join(pa.array([_CUT.split(t) for t in strange.to_pylist()], pa.list_(pa.large_string()))))
        order = np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable")
        return pa.concat_arrays(out).take(pa.array(np.argsort(order, kind="stable"))) if len(out) > 1 else out[0]

    def _join(self, parts: pa.Array) -> pa.Array:
        """Pieces are encoded once for each distinct one; the joined values of a text are a slice of the taken values."""
        if not len(parts):
            return pa.array([], pa.large_binary())
        flat = parts.flatten().dictionary_encode()
        data = pa.array(self._codes(flat.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(flat.indices)
        ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset :][: len(data) + 1] if len(data) else np.zeros(1, np.int64)
        at = ends[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        return pa.Array.from_buffers(pa.large_binary(), len(parts), [None, pa.py_buffer(at.tobytes()), data.buffers()[2]])


@functools.cache
def shared_encoder(path: str, plain: bool = False) -> Encoder:
    """One encoder a Python worker: tasks that follow each other there find the memo filled."""
    return Encoder(path, plain)


REMEMBERED.append(shared_encoder.cache_clear)


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Byte planes (4) or bit planes (32) of little-endian 32-bit ids."""
    if kind == "byte":
        return [x.tobytes() for x in ids.view(np.uint8).reshape(-1, 4).T]
    bits = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return [np.packbits(x, bitorder="little").tobytes() for x in bits.T]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)).view("<u4").reshape(-1)
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("<u4").reshape(-1)


class PlaneWriter:
    def __init__(self, out, kind: str = "byte", chunk: int = CHUNK):
        self.out, self.kind, self.chunk = out, kind, chunk
        self.packer = zstandard.ZstdCompressor(level=3)
        self.rest, self.held, self.at, self.index = [], 0, len(MAGIC), []
        self.docs: list[int] = []
        out.write(MAGIC)

    def add(self, ids: np.ndarray) -> None:
        self.docs.append(len(ids))
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= 16 * self.chunk:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.empty(0, "<u4")
        whole = len(ids) if last else len(ids) // self.chunk * self.chunk
        for s in range(0, whole, self.chunk):
            part = ids[s : min(s + self.chunk, whole)]
            packed = [self.packer.compress(p) for p in to_planes(np.ascontiguousarray(part), self.kind)]
            self.index.append((self.at, len(part), [len(p) for p in packed]))
            for p in packed:
                self.out.write(p)
                self.at += len(p)
        self.rest, self.held = [ids[whole:].copy()], len(ids) - whole

    def close(self) -> None:
        self.flush(True)
        planes = 4 if self.kind == "byte" else 32
        body = b"".join(struct.pack(f"<QI{planes}I", at, n, *sizes) for at, n, sizes in self.index)
        body += np.array(self.docs, "<u4").tobytes()
        self.out.write(body + struct.pack("<QQB", len(self.index), len(self.docs), planes) + MAGIC)


class PlaneReader:
    """Lengths of the documents and the chunks' ids, from the file alone."""

    def __init__(self, handle, size: int):
        self.handle = handle
        tail = struct.calcsize("<QQB") + len(MAGIC)
        handle.seek(size - tail)
        end = handle.read(tail)
        if end[-len(MAGIC) :] != MAGIC:
            raise ValueError("no plane file")
        chunks, docs, planes = struct.unpack("<QQB", end[: -len(MAGIC)])
        entry = struct.Struct(f"<QI{planes}I")
        handle.seek(size - tail - 4 * docs - entry.size * chunks)
        body = handle.read(entry.size * chunks + 4 * docs)
        self.kind = "byte" if planes == 4 else "bit"
        self.index = [entry.unpack_from(body, entry.size * i) for i in range(chunks)]
        self.docs = np.frombuffer(body, "<u4", offset=entry.size * chunks)
        self.unpacker = zstandard.ZstdDecompressor()

    def chunks(self) -> Iterator[np.ndarray]:
        for at, n, *sizes in self.index:
            self.handle.seek(at)
            planes = [self.unpacker.decompress(self.handle.read(s), max_output_size=max(n, 1)) for s in sizes]
            yield from_planes(planes, n, self.kind)

    def documents(self) -> Iterator[np.ndarray]:
        held, have, chunks = [], 0, self.chunks()
        for n in self.docs.tolist():
            while have < n:
                held.append(next(chunks))
                have += len(held[-1])
            ids = np.concatenate(held) if len(held) > 1 else held[0] if held else np.empty(0, "<u4")
            yield ids[:n]
            held, have = [ids[n:]], have - n


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about SLICE bytes of text, of one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy()
        groups = np.cumsum(sizes, dtype=np.int64) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            if e > s:
                yield batch.slice(s, e - s)


def _encoder(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        encoder = shared_encoder(path)
        end = np.array([end_id], encoder.dtype).tobytes()
        size = np.dtype(encoder.dtype).itemsize
        for batch in _slices(batches):
            ids = encoder.encode(batch.column("_text"))
            ids = pc.binary_join_element_wise(ids, pa.scalar(end, pa.large_binary()), pa.scalar(b"", pa.large_binary()))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), ids.cast(pa.binary()), pa.array([size] * len(ids), pa.int32())], ["_id", "_ids", "_size"])

    return run


def _file_writer(folder: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        name = writer = out = None
        place = 0
        for batch in text_rows(batches):
            if batch.num_rows and writer is None:
                fs.create_dir(path, recursive=True)
                name = f"{uuid.uuid4().hex}.planes"  # a task that is run again writes another; the index names what counts
                out = fs.open_output_stream(f"{path}/{name}", compression=None)
                writer = PlaneWriter(out, kind)
            counts = []
            for ids, size in zip(batch.column("_ids").to_pylist(), batch.column("_size").to_pylist(), strict=True):
                ids = np.frombuffer(ids, f"<u{size}").astype("<u4")
                writer.add(ids)
                counts.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_part"), pa.array([name] * len(counts), pa.string()), pa.array(range(place, place + len(counts)), pa.int64()), pa.array(counts, pa.int64())], ["_id", "_part", "file", "place", "n_tokens"])
            place += len(counts)
        if writer:
            writer.close()
            out.close()

    return run


def write_tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", planes: str = "byte") -> tuple[str, DataFrame]:
    """Write the plane files; give the folder and the staged index: id, part (order of the files), file, place in the
    file, n_tokens. Texts are encoded where they are read; only ids (2 bytes each hold them) are range-partitioned."""
    spark = docs.sparkSession
    folder = folder or new_dir(spark, "tokens")
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()
    encoded = staged(slim.mapInArrow(_encoder(tokenizer or default_tokenizer(), end_id), f"_id {kind}, _ids binary, _size int"), "ids")
    encoded = encoded.withColumn("_tie", F.xxhash64("_ids"))  # the driver samples the sort keys, so these stay small
    ordered = encoded.repartitionByRange(F.col("_id").asc_nulls_first(), F.col("_tie")).sortWithinPartitions(F.col("_id").asc_nulls_first(), F.col("_tie"))
    written = ordered.withColumn("_part", F.spark_partition_id()).mapInArrow(_file_writer(folder, planes), f"_id {kind}, _part int, file string, place bigint, n_tokens bigint")
    return folder, staged(written, "token-index").withColumnRenamed("_id", id_col).withColumnRenamed("_part", "part")


def _file_reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist(), strict=True):
                info = fs.get_file_info(f"{path}/{name}")
                with fs.open_input_file(info.path) as handle:
                    at, rows = first, []
                    for place, ids in enumerate(PlaneReader(handle, info.size).documents()):
                        rows.append((name, place, at, len(ids), zlib.crc32(np.ascontiguousarray(ids).tobytes())))
                        at += len(ids)
                        if len(rows) == 8192:
                            yield _read_batch(rows)
                            rows = []
                    if rows:
                        yield _read_batch(rows)

    return run


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), *[pa.int64()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["_file", "_place", "start", "n_tokens", "ids_crc32"])


def read_tokens(folder: str, index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens, ids_crc32 of every document, decoded from the files. The offset of a file is the running sum
    over the files' totals (one row a file); everything else is read where the file is."""
    files = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("n")).collect()  # one row a file
    rows, at = [], 0
    for r in sorted(files, key=lambda r: r["part"]):
        rows.append((r["file"], at))
        at += r["n"]
    spark = index.sparkSession
    listed = spark.createDataFrame(rows, "file string, first bigint").repartition(max(1, len(rows)), "file")
    back = listed.mapInArrow(_file_reader(folder), "_file string, _place bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    ids = index.select(id_col, "file", "place")
    # a merge join: what comes back has a row for each document, however short the list of files looks to the planner
    out = ids.join(back.hint("merge"), (ids["file"] == back["_file"]) & (ids["place"] == back["_place"]))
    return out.select(id_col, "start", "n_tokens", "ids_crc32")


def op9_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = write_tokens(table(spark, sf_dir, "documents"))
    return read_tokens(folder, index)
