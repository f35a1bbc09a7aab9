"""Operator 13: alignment of the tokens of two tokenizers over the same bytes.

A is a byte-level BPE, B a piece BPE with byte fallback; B puts a space before each text, so A gets one too.  A whole Arrow
batch is laid end to end.  The byte ends of all A and all B tokens are counted once; where both end is a cut, and the tokens
between two cuts are a group.  Each place where some token ends is the end of one stretch that one A token and one
B token share, so these places are the links; prefix sums over them number tokens, groups and links, and differences at
the documents' offsets give each document's part.

Corpus counts: a pair's count is the number of documents (rows) that hold it linked.  Tasks add up the pairs of
their documents, and only these sums are shuffled.  To bring counts back to documents, the ``TOP`` most frequent pairs are
sent to all tasks (a bound of 17 bytes each), which settles most links; the rest is exact by a join on the
pair, in which a pair has fewer rows than any pair of the sent ones.

Edge cases: null and empty texts, and texts whose tokens don't spell the space and the text (B reads U+2581 as a
space), have no tokens: all numbers 0 and an empty digest.  Special tokens' strings are plain text.  Repeated rows
count as documents of their own.  Empty tables give no rows.  Only doc_id and text are read, so other columns may have any name.

A runs in ``tiktoken`` on the JSON file's vocabulary: the loader checks that the file's merges are in the order of
their ids, which makes both libraries' merges the same; a test compares them over all code points.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import pieces, remove, with_fields, written
from tillroll.llm.wordhash import utf8

#: Pairs whose counts are sent to all tasks.
TOP = 1 << 18
#: Distinct pairs that a task holds before it gives its sums away.
HELD = 1 << 22
#: A pair is A's id above B's id in so many bits.
LOW = 16
_COUNTS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


class Bytes(NamedTuple):
    """The bytes of each token id, end to end, with their begins and lengths."""

    flat: np.ndarray
    begin: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes]) -> Bytes:
        length = np.array([len(t) for t in tokens], np.int64)
        return cls(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(length) - length, length)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        shift = self.begin[ids] - (np.cumsum(n) - n)
        return self.flat[np.repeat(shift, n) + np.arange(n.sum())]


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others by number from 256 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b != 32]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(2)
def encoder_a(file: bytes, pattern: str):
    """(encode, token bytes) of a byte-level BPE in the JSON form."""
    import tiktoken

    model, alphabet = json.loads(file)["model"], byte_alphabet()
    merged = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
    ids = [model["vocab"][a + b] for a, b in merged]
    if any(x >= y for x, y in zip(ids, ids[1:], strict=False)):
        raise ValueError("the merges must be in the order of their ids")
    tokens = {i: bytes(alphabet[c] for c in t) for t, i in model["vocab"].items() if all(c in alphabet for c in t)}
    encoding = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={t: i for i, t in tokens.items()}, special_tokens={})
    return encoding.encode_ordinary, Bytes.of([tokens.get(i, b"") for i in range(max(tokens) + 1)])


@lru_cache(2)
def encoder_b(file: bytes):
    """(encode many, token bytes) of a piece model with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=file)
    pieces_ = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    tokens = [bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces_)]
    return lambda texts: model.encode(texts, num_threads=1), Bytes.of(tokens)


class Aligned(NamedTuple):
    """Tokens and links of the documents of a batch; the number arrays have a place for each document."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray


def _ids(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids end to end, and each list's length."""
    n = np.array([len(x) for x in lists], np.int64)
    return np.fromiter((i for x in lists for i in x), np.int32, n.sum()), n


def align_batch(texts: pa.Array, encode_a, bytes_a: Bytes, encode_b, bytes_b: Bytes) -> Aligned:
    live = pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0)
    spaced = pc.if_else(live, pc.binary_join_element_wise(" ", pc.fill_null(texts, ""), ""), "")
    data, offsets = utf8(spaced)
    size, plain = np.diff(offsets), pc.fill_null(texts, "").to_pylist()
    a, n_a = _ids([encode_a(f" {t}") if t else [] for t in plain])
    b, n_b = _ids(encode_b(plain))
    number = np.arange(len(size))
    doc_a, doc_b, doc_data = np.repeat(number, n_a), np.repeat(number, n_b), np.repeat(number, size)
    # documents whose tokens spell other bytes go, first those of another length
    sizes = (np.bincount(d, bytes_.length[ids], len(size)).astype(np.int64) for d, ids, bytes_ in ((doc_a, a, bytes_a), (doc_b, b, bytes_b)))
    sound = np.logical_and.reduce([s == size for s in sizes])
    for turn in range(2):
        if not sound.all():
            a, b, data = a[sound[doc_a]], b[sound[doc_b]], data[sound[doc_data]]
            doc_a, doc_b, doc_data = doc_a[sound[doc_a]], doc_b[sound[doc_b]], doc_data[sound[doc_data]]
        if turn == 0:
            sound = np.ones(len(size), bool)
            sound[doc_data[(bytes_a.spelled(a) != data) | (bytes_b.spelled(b) != data)]] = False
    # 1 where an A token ends, 2 where a B token ends, 3 where both do: a cut
    ends = np.bincount(np.cumsum(bytes_a.length[a]) - 1, minlength=len(data)) + 2 * np.bincount(np.cumsum(bytes_b.length[b]) - 1, minlength=len(data))
    at = np.flatnonzero(ends)
    end = ends[at]
    is_a, is_b, cut = end & 1, end >> 1, end == 3
    link_a, link_b, group = (np.cumsum(x) - x for x in (is_a, is_b, cut.astype(np.int64)))
    doc = doc_data[at]
    per_doc = lambda x: np.bincount(doc[x], minlength=len(size))
    return Aligned(a, b, group[is_a > 0], group[is_b > 0], a[link_a], b[link_b], per_doc(is_a > 0), per_doc(is_b > 0), per_doc(cut), per_doc(end > 0))


@lru_cache(2)
def _decimals(n: int, width: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to ``n`` - 1, left-aligned, and how many each has."""
    number = np.arange(n)
    length = 1 + sum((number >= 10**k).astype(np.int64) for k in range(1, width))
    place = np.maximum(length[:, None] - 1 - np.arange(width), 0)
    return (number[:, None] // 10**place % 10 + 48).astype(np.uint8), length


def group_texts(x: Aligned, n_ids: int) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each document; ids are below ``n_ids``."""
    # a token comes behind the tokens of its own kind and those of the other kind in earlier groups (B: also in its own)
    at_a = np.arange(len(x.a)) + np.searchsorted(x.group_b, x.group_a, "left")
    at_b = np.arange(len(x.b)) + np.searchsorted(x.group_a, x.group_b, "right")
    item, sign = np.empty(len(at_a) + len(at_b), np.int64), np.full(len(at_a) + len(at_b), ord(","), np.uint8)
    item[at_a], item[at_b] = x.a, x.b
    sign[at_a[np.diff(x.group_a, append=-1) != 0]] = ord("|")
    sign[at_b[np.diff(x.group_b, append=-1) != 0]] = ord(";")
    digits, length = _decimals(n_ids)
    n = length[item] + 1
    upto = np.cumsum(n)
    begin = upto - n
    out = np.empty(int(upto[-1]) if len(upto) else 0, np.uint8)
    for k in range(int(n.max(initial=1)) - 1):
        has = np.flatnonzero(n > k + 1)
        out[begin[has] + k] = digits[item[has], k]
    out[upto - 1] = sign
    held, last = out.tobytes(), np.concatenate([[0], upto])[np.concatenate([[0], np.cumsum(x.n_a + x.n_b)])]
    return [held[i : max(i, j - 1)] for i, j in zip(last[:-1], last[1:], strict=True)]


def _lists(values: np.ndarray, n: np.ndarray) -> pa.Array:
    """Runs of ``n`` values each, as binary."""
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(n * values.itemsize)]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def align(docs: DataFrame, file_a: bytes, pattern: str, file_b: bytes, *, with_groups: bool = False) -> DataFrame:
    """A row for each row of ``docs``: row (a number), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the linked pairs.

    ``pairs`` has the distinct pairs as little-endian 64-bit numbers (A's id above B's), sorted, and ``times`` how many links each has (32 bits).
    ``with_groups`` adds the aligned groups themselves, as text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (encode_a, bytes_a), (encode_b, bytes_b) = encoder_a(file_a, pattern), encoder_b(file_b)
        row, n_ids = TaskContext.get().partitionId() << 40, max(len(bytes_a.length), len(bytes_b.length))
        for batch in batches:
            for part in pieces(batch, "text"):
                x = align_batch(part.column("text"), encode_a, bytes_a, encode_b, bytes_b)
                texts = group_texts(x, n_ids)
                doc = np.repeat(np.arange(part.num_rows, dtype=np.uint64), x.n_links)
                key, times = np.unique(doc << np.uint64(48) | x.link_a.astype(np.uint64) << np.uint64(LOW) | x.link_b.astype(np.uint64), return_counts=True)
                distinct = np.bincount((key >> np.uint64(48)).astype(np.int64), minlength=part.num_rows)
                digests = [hashlib.sha256(t).hexdigest() if t else "" for t in texts]
                columns = {
                    "row": pa.array(np.arange(row, row + part.num_rows)), "doc_id": part.column("doc_id"), "n_a": pa.array(x.n_a), "n_b": pa.array(x.n_b), "n_groups": pa.array(x.n_groups), "n_links": pa.array(x.n_links),
                    "groups_sha256": pa.array(digests, pa.string()), "pairs": _lists(key & np.uint64((1 << 48) - 1), distinct), "times": _lists(times.astype(np.uint32), distinct),
                }
                row += part.num_rows
                yield pa.RecordBatch.from_pydict(columns | ({"groups": pa.array([t.decode() for t in texts], pa.string())} if with_groups else {}))

    schema = with_fields([docs.schema["doc_id"]], f"{_COUNTS}, pairs binary, times binary" + ", groups string" * with_groups)
    schema.fields.insert(0, with_fields([], "row bigint")[0])
    schema.names.insert(0, "row")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): in how many rows of ``aligned`` each pair is linked.  Tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(n)], ["pair", "n"])

        for batch in batches:
            new, count = np.unique(np.concatenate([np.frombuffer(x, "<u8") for x in batch.column("pairs").to_pylist()] or [pair[:0]]), return_counts=True)
            both, at = np.unique(np.concatenate([pair, new]), return_inverse=True)
            pair, n = both, np.bincount(at, np.concatenate([n, count]), len(both)).astype(np.int64)
            if len(pair) > HELD:
                yield out()
                pair, n = pair[:0], n[:0]
        if len(pair):
            yield out()

    return aligned.select("pairs").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> int:
    """The least count that at most ``most`` pairs reach, up to an eighth of a power of two."""
    level = F.floor(F.log2("n") * 8)
    sizes, total = counts.groupBy(level.alias("level")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).orderBy(F.desc("level")).collect(), 0
    least = 1 << 62
    for row in sizes:
        total += row.pairs
        if total > most:
            break
        least = row.least
    return least


def with_counts(aligned: DataFrame, top: int = TOP) -> DataFrame:
    """``aligned`` (a written table) with n_best and count_sum instead of its pairs.

    n_best: links whose pair has the highest count of its A id in the corpus, ties included; count_sum: the sum of counts over links.
    """
    plain, plain_at = written(pair_counts(aligned), "pairs")
    best = plain.groupBy(F.shiftright("pair", LOW).alias("a")).agg(F.max("n").alias("best"))
    # one row for each id of A's vocabulary
    counts, _ = written(plain.withColumn("a", F.shiftright("pair", LOW)).join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("best")).alias("best")), "counts")
    remove(counts.sparkSession, plain_at)
    least = most_frequent(counts, top)
    sent = counts.filter(F.col("n") >= least).toArrow().sort_by("pair")
    known, known_n, known_best = (sent.column(c).to_numpy() for c in ("pair", "n", "best"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array([len(x) // 8 for x in batch.column("pairs").to_pylist()], np.int64)
            pair = np.frombuffer(b"".join(batch.column("pairs").to_pylist()), "<i8")
            times = np.frombuffer(b"".join(batch.column("times").to_pylist()), "<u4").astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), size)
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            found = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            add = lambda x: pa.array(np.bincount(row[found], x, batch.num_rows).astype(np.int64))
            n_best, count_sum = (add(times[found] * x[at[found]]) for x in ((known_best, known_n) if len(known) else (times, times)))
            rest, others = np.flatnonzero(~found), np.bincount(row[~found], minlength=batch.num_rows)
            items = pa.StructArray.from_arrays([pa.array(pair[rest]), pa.array(times[rest])], ["pair", "times"])
            left = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(others)]).astype(np.int32), items)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), n_best, count_sum, left], [*keep, "n_best", "count_sum", "rest"])

    keep = [c for c in aligned.columns if c not in ("pairs", "times")]
    schema = with_fields([aligned.schema[c] for c in keep], "n_best bigint, count_sum bigint, rest array<struct<pair:bigint,times:bigint>>")
    some, _ = written(aligned.mapInArrow(run, schema), "sums")
    rare = some.select("row", F.inline("rest")).join(counts.filter(F.col("n") < least), "pair")
    more = rare.groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("int")).alias("b"), F.sum(F.col("times") * F.col("n")).alias("s"))
    total = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
    return some.join(more, "row", "left").select(*(c for c in keep if c != "row"), total("n_best", "b"), total("count_sum", "s"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = []
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        with open(public_tokenizers.path(name), "rb") as file:
            files.append(file.read())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    aligned, at = written(align(docs, files[0], public_tokenizers.PATTERN, files[1]), "aligned")
    out = with_counts(aligned)
    remove(spark, at)
    return out


QUERIES = {"op13_alignment": op13_alignment}
ORACLES: dict[str, str] = {}
