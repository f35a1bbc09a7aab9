"""Operator 8: WARC archives, written with revisit records and read with salvage.

``archive`` writes one gzip member for each record.  Of rows with equal payloads of ``least`` bytes or
more, the one with the least page_id is the response, the others revisit it.  ``read_archives`` checks
each member (gzip CRC, version line, header block, Content-Length, block and payload digest).  Where a check fails, it
searches for the next gzip member that opens with a version line or the next plain version line,
goes on from there, and logs the bytes between as a quarantined gap.  Inside a member the search goes on in the
inflated bytes, also in those that a damaged or truncated member yields before its fault.

Digests and page_ids alone are grouped, never payloads; a payload shared by very many pages is
counted before the shuffle.  A shard's name is of its task attempt; the table of names is written before shards
are read, so that a lost executor's unfinished shards are never read.  ``pages`` is read twice and must give the same rows
in the same partitions both times, as files do.

Edge cases: null html counts as an empty payload; equal page_ids with equal html are one response and
revisits of it; repeated rows give repeated records; a null page_id sorts behind all others, and where a
payload has no other page_id, its records are all responses.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import pieces, scratch, written

SHARD = 32 << 20
_HEAD = re.compile(rb"WARC/1\.[01]\r\n")
_GZIP = b"\x1f\x8b\x08"
#: Bytes that a member is fed with at a time.
_STEP = 1 << 16


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def page_record(page_id, url: str | None, payload: bytes, length: int, sha: str, refers_to) -> bytes:
    """A response with its payload, or a revisit with the response's headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    clean = re.sub(r"[\r\n]+", " ", url or "urn:none")
    fields = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {clean}')}>", "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Target-URI": clean, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{sha}", "WARC-Block-Digest": f"sha1:{digest(block)}",
    }
    if page_id is not None:
        fields["X-Page-ID"] = str(page_id)
    if refers_to is not None:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page-ID": str(refers_to)}
    return record(fields, block)


def archive(pages: DataFrame, folder: str, *, least: int = 0, level: int = 1) -> DataFrame:
    """Writes the pages' records into shards below ``folder``; the (shard, records) written, as a table."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    ids = pages.select("page_id", "url", F.sha1(payload).alias("sha"), F.octet_length(payload).alias("n")).filter(F.col("n") >= least)
    # of a page's rows of one payload the least url is first; rows that are equal in all are counted
    urls = ids.groupBy("page_id", "sha", "url").agg(F.count("*").alias("copies"))
    own = urls.groupBy("page_id", "sha").agg(F.min(F.struct("url", "copies")).alias("least"))
    # digests of hot payloads are joined with one row each; the join may be split where they gather
    firsts = own.groupBy("sha").agg(F.min("page_id").alias("first"))
    refs, _ = written(own.join(firsts, "sha").select(F.col("page_id").alias("page"), F.col("sha").alias("digest"), "first", F.col("least.url").alias("first_url"), F.col("least.copies").alias("copies")), "refs")
    marked = pages.select("page_id", "url", "html", F.sha1(payload).alias("sha"))
    joined = marked.join(refs, F.col("page_id").eqNullSafe(F.col("page")) & (F.col("sha") == F.col("digest")), "left")
    one = F.coalesce((F.col("page_id") == F.col("first")) & F.col("url").eqNullSafe(F.col("first_url")), F.lit(False))
    joined = joined.withColumn("one", one).withColumn("refers_to", F.when(~F.col("one"), F.col("first")))
    columns = ["page_id", "url", "html", "refers_to"]
    if refs.filter((F.col("page") == F.col("first")) & (F.col("copies") > 1)).isEmpty():
        joined = joined.select(columns)
    else:
        # rows equal in all are made anew from one of them: a response and its revisits
        several = F.col("one") & (F.col("copies") > 1)
        again = joined.filter(several).dropDuplicates(["page_id", "sha", "url"]).withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("copies")))).withColumn("refers_to", F.when(F.col("turn") > 1, F.col("first")))
        joined = joined.filter(~several).select(columns).unionByName(again.repartition("page_id", "turn").select(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base)
        name, out, size, count, done = "", None, 0, 0, []
        for batch in batches:
            for part in pieces(batch, "html", 1 << 22):
                for row in part.to_pylist():
                    if out is None:
                        name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = files.open_output_stream(f"{base}/{name}", compression=None)
                        info = member(record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"), level)
                        out.write(info)
                    body = (row["html"] or "").encode()
                    data = member(page_record(row["page_id"], row["url"], body, len(body), digest(body), row["refers_to"]), level)
                    out.write(data)
                    size, count = size + len(data), count + 1
                    if size >= SHARD:
                        out.close()
                        done.append((name, count))
                        out = None
        if out is not None:
            out.close()
            done.append((name, count))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], ["shard", "records"])

    return written(joined.mapInArrow(run, "shard string, records bigint"), "warc-shards")[0]


class Damaged(ValueError):
    """A record that fails a check.  ``end`` is where its stated length ends, if a record's end stands there."""

    def __init__(self, reason: str, end: int | None = None) -> None:
        super().__init__(reason)
        self.end = end


#: Headers of a record that was found inside a gap: it may be a record, or a part of a damaged record's payload.
DOUBTFUL = "(doubtful)"
_HASHES = {"sha1": hashlib.sha1, "sha256": hashlib.sha256, "sha384": hashlib.sha384, "sha512": hashlib.sha512, "md5": hashlib.md5}


def _headers(block: bytes) -> dict[str, str]:
    """Header fields; lines that begin with white space go on with the line before."""
    out: dict[str, str] = {}
    key = ""
    for line in block.split(b"\r\n"):
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and key:
            out[key] = f"{out[key]} {text.strip()}".strip()
            continue
        name, colon, value = text.partition(":")
        if not colon:
            raise Damaged("a header line without a colon")
        key = name.strip().lower()
        out[key] = value.strip()
    return out


def fits(stated: str, data: bytes) -> bool:
    """Whether a digest (``algorithm:value`` in base32 or hexadecimal digits of any case) is that of the bytes; one of an unknown algorithm isn't checked."""
    name, _, value = stated.partition(":")
    made = _HASHES.get(name.strip().lower().replace("-", ""))
    if not made:
        return True
    raw, value = made(data).digest(), value.strip().rstrip("=").upper()
    return value in (raw.hex().upper(), base64.b32encode(raw).decode().rstrip("="))


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the plain record at ``at``; :class:`Damaged` where a check fails."""
    begin = _HEAD.match(data, at)
    stop = data.find(b"\r\n\r\n", at)
    if not begin or stop < 0:
        raise Damaged("no version line or no end of the headers")
    fields = _headers(data[begin.end() : stop])
    stated = fields.get("content-length", "")
    end = stop + 4 + int(stated) if stated.isascii() and stated.isdigit() else -1
    if end < 0 or data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("the length doesn't fit")
    block = data[stop + 4 : end]
    if (sha := fields.get("warc-block-digest")) and not fits(sha, block):
        raise Damaged("the block's digest doesn't fit", end + 4)
    if fields.get("warc-type") == "response" and (sha := fields.get("warc-payload-digest")) and not fits(sha, block.partition(b"\r\n\r\n")[2]):
        raise Damaged("the payload's digest doesn't fit", end + 4)
    return fields, block, end + 4


def _inflated(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """(bytes, end, reason) of the gzip member at ``at``; with a reason, the bytes are those before its fault."""
    opener, out, place = zlib.decompressobj(31), [], at
    while not opener.eof and place < len(data):
        chunk, before = data[place : place + _STEP], opener.copy()
        try:
            out.append(opener.decompress(chunk))
        except zlib.error as error:
            for i in range(0, len(chunk), 64):  # what the chunk yields before the fault
                try:
                    out.append(before.decompress(chunk[i : i + 64]))
                except zlib.error:
                    break
            return b"".join(out), place, str(error)
        place += len(chunk)
    return b"".join(out), place - len(opener.unused_data), None if opener.eof else "the member has no end"


def _opens(data: bytes, at: int) -> bool:
    """Whether a gzip member at ``at`` begins with a version line."""
    try:
        return bool(_HEAD.match(zlib.decompressobj(31).decompress(data[at : at + 1024], 16)))
    except zlib.error:
        return False


class _Places:
    """The next place from which records may be read; each byte is searched once, however many places are asked for."""

    def __init__(self, data: bytes) -> None:
        self.data, self.version, self.packed = data, -1, -1

    def after(self, at: int) -> int:
        data, end = self.data, len(self.data)
        if self.version < at:
            found = _HEAD.search(data, at)
            self.version = found.start() if found else end
        if self.packed < at:
            self.packed = at - 1
            while True:
                found = data.find(_GZIP, self.packed + 1)
                self.packed = end if found < 0 else found
                if found < 0 or found > self.version or _opens(data, found):
                    break
        return min(self.version, self.packed)


def _border(data: bytes, at: int) -> bool:
    """Whether a record or member may begin at ``at``, or the data end there."""
    return at >= len(data) or bool(_HEAD.match(data, at)) or data.startswith(_GZIP, at)


class _Found:
    """Records in order.  Those behind a search wait until their run ends: if another record, or the data's end, follows, the search
    had found the next record; otherwise it may have found a record inside the damaged one's payload, and they are doubtful."""

    def __init__(self, data: bytes) -> None:
        self.data, self.sound, self.waiting, self.searched = data, [], [], False

    def add(self, at: int, fields: dict[str, str], block: bytes) -> None:
        (self.waiting if self.searched else self.sound).append((at, fields, block))

    def stop(self, at: int, search: bool) -> None:
        """The run of records ends at ``at``; ``search`` tells that the next one has to be searched for."""
        sure = _border(self.data, at)
        self.sound += [(a, f if sure else f | {DOUBTFUL: "found inside a gap"}, b) for a, f, b in self.waiting]
        self.waiting = []
        self.searched = search or self.searched and not sure


def _plain(plain: bytes) -> tuple[list[tuple[dict[str, str], bytes]], list[tuple[int, int, str]]]:
    """The records of inflated bytes, and the gaps between them."""
    found, gaps, at, places = _Found(plain), [], 0, None
    while at < len(plain):
        try:
            fields, block, end = parse_record(plain, at)
            found.add(at, fields, block)
            at = end
        except Damaged as error:
            jump = error.end is not None and _border(plain, error.end)
            found.stop(at, not jump)
            places = places or _Versions(plain)
            after = error.end if jump else places.after(at + 1)
            gaps.append((at, after, str(error)))
            at = after
    found.stop(at, False)
    return [(fields, block) for _, fields, block in found.sound], gaps


class _Versions(_Places):
    """Places in inflated bytes: version lines only."""

    def after(self, at: int) -> int:
        self.packed = len(self.data)
        return super().after(at)


def salvage(data: bytes) -> tuple[list[tuple[int, dict[str, str], bytes]], list[tuple[int, int, str]]]:
    """The records of an archive as (offset, headers, block) and the gaps as (begin, end, reason).

    Offsets are of the archive's bytes; a gap inside a member spans the member, and its reason names the inflated bytes.
    Where a digest alone is wrong, the stated end is the end of the gap.  A record that was searched for, and whose
    end no other record follows, may be a part of a damaged record's payload: it has the header :data:`DOUBTFUL`.
    """
    found, gaps, at, places = _Found(data), [], 0, _Places(data)

    def quarantine(begin: int, end: int, why: str) -> None:
        if gaps and gaps[-1][1] == begin:
            gaps[-1] = gaps[-1][0], end, gaps[-1][2]
        else:
            gaps.append((begin, end, why))

    while at < len(data):
        jump = None
        if data.startswith(_GZIP, at):
            plain, end, why = _inflated(data, at)
            inside, inner = _plain(plain)
            found.stop(at, False)
            found.sound += [(at, fields, block) for fields, block in inside]
            if why is None:
                gaps += [(at, end, f"inflated bytes {a} to {b}: {reason}") for a, b, reason in inner]
                at = end
                continue
        else:
            try:
                fields, block, end = parse_record(data, at)
                found.add(at, fields, block)
                at = end
                continue
            except Damaged as error:
                why, jump = str(error), error.end if error.end is not None and _border(data, error.end) else None
        found.stop(at, jump is None)
        after = places.after(at + 1) if jump is None else jump
        quarantine(at, after, why)
        at = after
    found.stop(at, False)
    return found.sound, gaps


_ROW = {"shard": pa.string(), "offset": pa.int64(), "gap_end": pa.int64(), "reason": pa.string(), "page_id": pa.string(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "payload": pa.string(), "doubtful": pa.bool_()}


def read_archives(shards: DataFrame, folder: str, *, payloads: bool = False, strict: bool = False) -> DataFrame:
    """A row for each page record of the shards, and for each quarantined gap one with its ``reason``.

    ``payload_bytes`` and ``payload_digest`` are of the full payload, for revisits from their headers.  ``doubtful`` marks records that may be a part of a damaged one.  ``strict``
    raises where a shard has a gap or yields another number of page records than ``shards`` says.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for shard, expected in zip(batch.column("shard").to_pylist(), batch.column("records").to_pylist(), strict=True):
                with files.open_input_file(f"{base}/{shard}") as file:
                    records, gaps = salvage(file.read())
                n = sum(fields.get("warc-type") in ("response", "revisit") for _, fields, _ in records)
                if strict and (gaps or n != expected):
                    raise ValueError(f"{shard} holds {n} of {expected} page records and {len(gaps)} gaps")
                rows = [dict.fromkeys(_ROW) | {"shard": shard, "offset": a, "gap_end": b, "reason": why} for a, b, why in gaps]
                for at, fields, block in records:
                    if fields.get("warc-type") not in ("response", "revisit"):
                        continue
                    http, _, body = block.partition(b"\r\n\r\n")
                    length = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
                    rows.append({
                        "shard": shard, "offset": at, "gap_end": None, "reason": None, "page_id": fields.get("x-page-id"), "url": fields.get("warc-target-uri"),
                        "record_type": fields["warc-type"], "refers_to": fields.get("x-refers-to-page-id"), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"),
                        "payload_bytes": len(body) if fields["warc-type"] == "response" else int(length[1]) if length else None, "payload": body.decode("utf-8", "replace") if payloads else None, "doubtful": DOUBTFUL in fields,
                    })
                for i in range(0, len(rows), 2000):
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[i : i + 2000]], kind) for c, kind in _ROW.items()], list(_ROW))

    names = {pa.int64(): "bigint", pa.bool_(): "boolean", pa.string(): "string"}
    schema = ", ".join(f"{c} {names[kind]}" for c, kind in _ROW.items())
    return shards.select("shard", "records").repartition(max(1, shards.sparkSession.sparkContext.defaultParallelism * 4)).mapInArrow(run, schema)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    kind = pages.schema["page_id"].dataType
    found = read_archives(archive(pages, folder), folder, strict=True)
    return found.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))


QUERIES = {"op8_warc": op8_warc}
ORACLES = {
    "op8_warc": """WITH p AS (SELECT page_id, row_number() OVER (PARTITION BY page_id, html) AS copy, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
  q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
  SELECT page_id, octet_length(b) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(j // 4 * 5 + 1 AS INTEGER), 5) AS INTEGER) // CAST(pow(32, 3 - j % 4) AS INTEGER)) % 32 + 1 AS INTEGER), 1)), '') AS payload_digest,
    CASE WHEN page_id = first AND copy = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first AND copy = 1 THEN NULL ELSE first END AS refers_to FROM q"""
}
