"""WARC archives as seekable Zstandard bundles.

Each task writes its records into bundle files of the shared folder. Records are grouped into frames that are compressed
alone; a skippable frame at the end holds the seek table (compressed and plain size of each frame, the public
seekable-format layout), and an index maps each record to its frame and its offset inside the plain frame, so one record
is read by decompressing one frame. Records with equal payloads become one response (that with the largest id) and
revisits without payload.

Defined results: a null payload or url counts as empty; payloads are never cut; of records without an id only those
whose copies all lack one are responses; rows that repeat the largest id of their payload are all responses; an empty table writes no bundle and gives an empty index. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import new_dir, small, staged, table, text_rows

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 64 << 20
#: Records are handed on in batches of about so many bytes; a reading task takes about so many frames.
EMIT_BYTES, READ_FRAMES = 8 << 20, 16
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, digest: str, n_bytes: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a revisit if refers_to is given. A revisit's block is empty; the length of the payload that
    it stands for is kept in a header."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {url.translate(_ONE_LINE)}",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n_bytes}",
    ]
    if kind == "revisit":
        payload = b""
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(head).encode() + payload + b"\r\n\r\n"


_ONE_LINE = {10: "%0A", 13: "%0D"}


def parse_record(plain: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and the place after the record."""
    end = plain.index(b"\r\n\r\n", at)
    lines = plain[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    start, n = end + 4, int(headers["Content-Length"])
    return headers, plain[start : start + n], start + n + 4


class BundleWriter:
    """A seekable bundle: frames, then the seek table."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        self.out, self.frame_bytes = out, frame_bytes
        self.plain, self.frames, self.written = bytearray(), [], 0
        self.packer = zstandard.ZstdCompressor(level=3)

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame number and offset of the record inside the plain frame."""
        if self.plain and len(self.plain) + len(data) > self.frame_bytes:
            self.flush()
        at = len(self.plain)
        self.plain += data
        return len(self.frames), at

    def flush(self) -> None:
        if self.plain:
            packed = self.packer.compress(bytes(self.plain))
            self.frames.append((len(packed), len(self.plain)))
            self.out.write(packed)
            self.written += len(packed)
            self.plain = bytearray()

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)


class BundleReader:
    """Reads frames of a bundle through its seek table."""

    def __init__(self, handle, size: int):
        self.handle = handle
        handle.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", handle.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        handle.seek(size - 9 - 8 * n)
        entries = handle.read(8 * n)
        self.frames, at = [], 0
        for i in range(n):
            packed, plain = struct.unpack_from("<II", entries, 8 * i)
            self.frames.append((at, packed, plain))
            at += packed
        self.unpacker, self.last = zstandard.ZstdDecompressor(), (-1, b"")

    def frame(self, number: int) -> bytes:
        if self.last[0] != number:
            at, packed, plain = self.frames[number]
            self.handle.seek(at)
            self.last = (number, self.unpacker.decompress(self.handle.read(packed), max_output_size=plain))
        return self.last[1]


def digest_column(payload: Column) -> Column:
    """payload_digest as a column expression: 40 hex digits are eight groups of 20 bits, each four base-32 digits."""
    hexes = F.sha1(payload.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(hexes, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        out = bundle = name = None
        size = 0
        for batch in text_rows(batches):
            cols = [batch.column(c).to_pylist() for c in ("_id", "_url", "_html", "_digest", "_bytes", "_target")]
            names, frames, offsets = [], [], []
            for page_id, url, html, digest, n_bytes, target in zip(*cols, strict=True):
                if bundle is None or size > BUNDLE_BYTES:
                    if bundle:
                        bundle.close()
                        out.close()
                    name, size = f"{uuid.uuid4().hex}.warc.zst", 0  # a task that is run again writes others; the index names what counts
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    bundle = BundleWriter(out)
                data = record(page_id, url or "", (html or "").encode("utf-8", "surrogatepass"), digest, n_bytes, target)
                frame, offset = bundle.add(data)
                size += len(data)
                names.append(name)
                frames.append(frame)
                offsets.append(offset)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(names, pa.string()), pa.array(frames, pa.int32()), pa.array(offsets, pa.int64())], ["_id", "bundle", "frame", "frame_offset"])
        if bundle:
            bundle.close()
            out.close()

    return run


def write_bundles(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[str, DataFrame]:
    """Write all records; give the folder and the staged index (id, bundle, frame, frame_offset).

    Payloads are equal if their SHA-256 and length are (SHA-1, the digest of the format, has known collisions). The
    largest id of a payload is found by a partial aggregation, so a payload that a third of the pages share stays cheap.
    The list of repeated payloads is broadcast if it is counted as small, and no page is shuffled; else the join is on the
    SHA-256 and is split by Spark where one is hot."""
    spark = pages.sparkSession
    folder = folder or new_dir(spark, "warc")
    slim = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.coalesce(html_col, F.lit("")).alias("_html"))
    kind = slim.schema["_id"].dataType.simpleString()
    made = slim.select("*", F.sha2(F.col("_html").cast("binary"), 256).alias("_same"), digest_column(F.col("_html")).alias("_digest"), F.octet_length("_html").cast("bigint").alias("_bytes"))
    best = made.groupBy(F.col("_same").alias("_d"), F.col("_bytes").alias("_b")).agg(F.count("*").alias("_n"), F.max("_id").alias("_best"))
    best = small(best.filter("_n > 1").drop("_n"), "repeated")
    joined = made.join(best, (made["_same"] == best["_d"]) & (made["_bytes"] == best["_b"]), "left")
    target = F.when(~F.col("_id").eqNullSafe(F.col("_best")), F.col("_best"))
    records = joined.select("_id", "_url", F.when(target.isNull(), F.col("_html")).alias("_html"), "_digest", "_bytes", target.alias("_target"))
    index = records.mapInArrow(_writer(folder), f"_id {kind}, bundle string, frame int, frame_offset bigint")
    return folder, staged(index, "warc-index").withColumnRenamed("_id", id_col)


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        name, reader, handle = None, None, None
        rows: list[tuple] = []
        held = 0

        def emit() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), *[pa.string()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], READ_COLUMNS)

        for batch in batches:
            for bundle, frame, offset in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "frame_offset")), strict=True):
                if bundle != name:
                    if handle:
                        handle.close()
                    info = fs.get_file_info(f"{path}/{bundle}")
                    handle = fs.open_input_file(info.path)
                    name, reader = bundle, BundleReader(handle, info.size)
                headers, block, _ = parse_record(reader.frame(frame), offset)
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if headers["WARC-Type"] == "response" and (payload_digest(block) != digest or len(block) != int(headers["X-Payload-Length"])):
                    raise ValueError(f"damaged record in {bundle}, frame {frame}, offset {offset}")
                rows.append((headers["WARC-Record-ID"][10:-1], int(headers["X-Payload-Length"]), digest, headers["WARC-Type"], headers.get("WARC-Refers-To", "")[10:-1] or None, headers["WARC-Target-URI"], block.decode("utf-8", "surrogatepass")))
                held += len(block) + 500
                if held > EMIT_BYTES:
                    yield emit()
                    rows.clear()
                    held = 0
        if rows:
            yield emit()

    return run


READ_COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]


def read_bundles(folder: str, index: DataFrame) -> DataFrame:
    """Every indexed record, read through index and seek table; ids come back as the strings of the record headers
    (empty: null). Payload digests and lengths are verified; a damaged record is an error."""
    n_frames = index.select("bundle", "frame").distinct().count()
    slim = index.select("bundle", "frame", "frame_offset")  # so small that Spark alone would read all in one task
    frames = slim.repartition(max(1, -(-n_frames // READ_FRAMES)), "bundle", "frame").sortWithinPartitions("bundle", "frame", "frame_offset")
    kinds = "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, url string, payload string"
    return frames.mapInArrow(_reader(folder), kinds).withColumn("page_id", F.nullif("page_id", F.lit("")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = write_bundles(table(spark, sf_dir, "pages"))
    back = read_bundles(folder, index)
    return back.select(F.col("page_id").cast("bigint"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS hex, max(page_id) OVER (PARTITION BY h) AS best, count(*) OVER (PARTITION BY h) AS n FROM p),
b AS (SELECT *, array_to_string(list_transform(regexp_extract_all(hex, '.'), lambda c: lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0')), '') AS bits FROM x)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (list_sum(list_transform(range(0, 5), lambda k: CASE WHEN substr(bits, (5 * i + k + 1)::BIGINT, 1) = '1' THEN (1 << (4 - k)::INTEGER) ELSE 0 END)))::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM b
"""
