"""Operator 7: media columns whose payloads lie in tar shards, addressed by content.

``store`` writes each distinct payload of a task once into a tar shard, as a member named by the
SHA-256 of the stored form, and keeps a row (digest, shard, offset, length) for each document.  The
least (shard, offset) of a digest is its address, so rows of equal content share one address, also
across shards.  The stored form is a PNG of 8-bit grey samples, 64 to a row.  ``with_header`` reads the
first 33 bytes of each member only and fills the metadata columns; ``with_payload`` reads whole members for what
needs the samples.

A task writes its shard under a name of its own attempt, and rows carry that name, so a repeated
attempt after a lost executor leaves an unused file and no wrong row.  The rows are written as a table
before anything reads them.  Shards lie in the shared folder.

Edge cases: null and empty texts are 64 bytes 0; equal texts have equal values in all columns;
repeated rows give repeated rows; other columns are ignored by ``store``, and pass through ``with_header`` and
``with_payload`` unless they have the name of a column that is added.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import pieces, scratch, with_fields, written

WIDTH = 64
#: A shard is closed when it holds so many bytes.
SHARD = 64 << 20
_MAGIC = b"\x89PNG\r\n\x1a\n"
HEADER = 33


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, level: int = 1) -> bytes:
    """A grey PNG with one sample for each byte of a payload of whole rows."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first 33 bytes; raises ValueError where they aren't a sound header."""
    if head[:8] != _MAGIC or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("no PNG header")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def from_png(data: bytes) -> bytes:
    """The samples of a PNG that :func:`to_png` wrote."""
    width, height, _ = png_header(data[:HEADER])
    at, body = HEADER, []
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IDAT":
            body.append(part)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered row")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """A mean hash: one bit for each of the 64 columns, set where its mean exceeds the whole mean."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    total = samples.sum(axis=0, dtype=np.int64)
    bits = total * WIDTH > total.sum()
    return f"{np.packbits(bits).tobytes().hex()}:{total.sum() / samples.size:.6f}"


class _Shards:
    """Writes tar shards below a folder given as a URI."""

    def __init__(self, folder: str) -> None:
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.folder)
        self.name, self.out, self.at, self.known = "", None, 0, {}

    def put(self, data: bytes) -> tuple[str, str, int, int]:
        digest = hashlib.sha256(data).hexdigest()
        if digest not in self.known:
            if self.out is None:
                self.name, self.at, self.known = f"{uuid.uuid4().hex}.tar", 0, {}
                self.out = self.files.open_output_stream(f"{self.folder}/{self.name}", compression=None)
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + data + bytes(-len(data) % 512))
            self.known[digest] = self.name, digest, self.at + len(head), len(data)
            self.at += len(head) + len(data) + -len(data) % 512
        found = self.known[digest]
        if self.at >= SHARD:
            self.close()
        return found

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out, self.known = None, {}


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Writes the payloads of all rows; (doc_id, n_bytes, shard, digest, offset, length) of each row as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(folder)
        for batch in batches:
            for part in pieces(batch, "text", 1 << 22):
                raws = [(t or "").encode() for t in part.column("text").to_pylist()]
                places = [shards.put(to_png(padded(raw))) for raw in raws]
                shard, digest, offset, length = zip(*places, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, raws), pa.int64()), pa.array(shard), pa.array(digest), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], ["doc_id", "n_bytes", "shard", "digest", "offset", "length"])
        shards.close()

    schema = with_fields([docs.schema["doc_id"]], "n_bytes bigint, shard string, digest string, offset bigint, length bigint")
    rows = docs.select("doc_id", "text").mapInArrow(run, schema)
    return written(rows, "media-rows")[0]


def addressed(rows: DataFrame) -> DataFrame:
    """``rows`` with one address for each digest: its least (shard, offset)."""
    first = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset")).alias("at"))
    return rows.drop("shard", "offset").join(first, "digest").select("doc_id", "n_bytes", F.col("at.shard").alias("shard"), "digest", F.col("at.offset").alias("offset"), "length")


class _Reader:
    """Range reads of members; keeps one shard open."""

    def __init__(self, folder: str) -> None:
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.name, self.file = "", None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            if self.file:
                self.file.close()
            self.name, self.file = shard, self.files.open_input_file(f"{self.folder}/{shard}")
        self.file.seek(offset)
        return self.file.read(length)


_HEADER = {"width": pa.int64(), "height": pa.int64(), "bits": pa.int64()}
_PAYLOAD = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "read_digest": pa.string(), "feature": pa.string()}


def _with(rows: DataFrame, folder: str, new: dict[str, pa.DataType], values: Callable[[_Reader, str, int, int], tuple]) -> DataFrame:
    """``rows`` with the columns ``new``, which ``values`` reads from the member at (shard, offset, length); neighbours of one place are read once."""
    rest = [c for c in rows.columns if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last, found = _Reader(folder), None, ()
        for batch in batches:
            out = []
            for place in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if place != last:
                    found, last = values(reader, *place), place
                out.append(found)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *(pa.array([x[i] for x in out], kind) for i, kind in enumerate(new.values()))], [*rest, *new])

    ddl = ", ".join(f"{c} {'bigint' if kind == pa.int64() else 'string'}" for c, kind in new.items())
    return rows.select(*(F.col(f"`{c.replace('`', '``')}`") for c in rest)).mapInArrow(run, with_fields([rows.schema[c] for c in rest], ddl))


def with_header(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` with width, height and bits, from range reads of the headers alone."""
    return _with(rows, folder, _HEADER, lambda reader, shard, offset, length: png_header(reader.read(shard, offset, HEADER)))


def with_payload(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` with what the stored members yield when they are read whole."""

    def values(reader: _Reader, shard: str, offset: int, length: int) -> tuple:
        data = reader.read(shard, offset, length)
        payload = from_png(data)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), hashlib.sha256(data).hexdigest(), feature(payload)

    return _with(rows, folder, _PAYLOAD, values)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "media-shards")
    rows = addressed(store(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder))
    # neighbours in a shard are read one after another; members of one digest need one read
    placed = rows.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")
    found = with_payload(with_header(placed, folder), folder)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), F.col("read_digest").alias("media_sha256"), "feature", "width", "height", "bits", "shard", "offset")


def members(tar: bytes) -> dict[str, bytes]:
    """The members of a shard, by Python's own reader."""
    with tarfile.open(fileobj=io.BytesIO(tar)) as held:
        return {m.name: held.extractfile(m).read() for m in held.getmembers()}


QUERIES = {"op7_media": op7_media}
ORACLES: dict[str, str] = {}
