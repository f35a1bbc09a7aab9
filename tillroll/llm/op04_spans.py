"""Operator 4: substring deduplication over sliding spans of consecutive sentences.

A sentence ends behind ``.``, ``!`` or ``?`` (and closing quotes or brackets) before white space, or at
a line break; pieces without words belong to the sentence before them.  From each sentence the shortest run of
at least ``sentences`` consecutive sentences with ``least`` words or more is taken, forwards and
backwards, and hashed by its words; so every sentence of a repeated passage of that many sentences and words
lies in some hashed run of the passage.  Runs are joined by hash over all documents.  The first
place of a run (least doc_id, then text hash, then position) stays; sentences covered by any other place of it are removed.

Spans are made once and written to the shared folder.  Counts are combined before the shuffle, and only hashes that
occur twice meet the spans again.  A hash that holds more than a 65,536th of all spans is hot; there are
at most 65,536 of those, so they are broadcast and their rows never meet in one task.

Edge cases: null texts stay null and empty ones empty; runs of fewer words than ``least`` are left
alone, so a text of fewer words never changes.  Repeats inside one text count.  Different texts of one doc_id
are documents of their own; repeated rows of one doc_id and text are one place and stay alike; null doc_ids are
left alone and don't count.  Other columns pass through, whatever their names; only one called ``removed`` is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import pieces, with_fields, written
from tillroll.llm.wordhash import mix, words

#: Sentences and words that a span holds at least.
SENTENCES, LEAST = 2, 20
#: A span is hot if it holds more than this part of all spans, and more than ``FEW`` places.
HOT, FEW = 1 << 16, 1000
_END = re.compile(rb"[.!?][\"')\]]*\s+|\n\s*")


def sentence_starts(text: bytes) -> list[int]:
    """Byte offsets where sentences begin; the first is 0."""
    cuts = [m.end() for m in _END.finditer(text)]
    return [0, *(c for c in cuts if c < len(text))]


def spans_of(column: pa.Array, least: int, sentences: int = SENTENCES) -> tuple[np.ndarray, ...]:
    """(row, begin byte, end byte, hash, words) of the spans of all texts; bytes count from the text's start."""
    found = words(column)
    data, base = found.data.tobytes(), found.offsets
    starts = [np.array(sentence_starts(data[base[i] : base[i + 1]]), np.int64) + base[i] for i in range(len(column)) if base[i] < base[i + 1]]
    if not starts or not len(found.begin):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    cut = np.concatenate(starts)
    worded = np.diff(np.append(np.searchsorted(found.begin, cut), len(found.begin))) > 0
    cut = cut[worded]
    row = np.searchsorted(base, cut, side="right") - 1
    first_word = np.append(np.searchsorted(found.begin, cut), len(found.begin))
    n = len(cut)
    last_of_row = np.searchsorted(row, row, side="right")
    first_of_row = np.searchsorted(row, row, side="left")
    # forwards: the least e with first_word[e] - first_word[i] >= least; backwards: the greatest such b; both as far as ``sentences``
    ahead = np.searchsorted(first_word, first_word[:-1] + least)
    back = np.searchsorted(first_word, first_word[1:] - least, side="right") - 1
    i = np.concatenate([np.arange(n), np.minimum(back, np.arange(1, n + 1) - sentences)])
    e = np.concatenate([np.maximum(ahead, np.arange(n) + sentences), np.arange(1, n + 1)])
    owner = np.concatenate([row, row])
    fits = (i >= np.concatenate([first_of_row, first_of_row])) & (e <= np.concatenate([last_of_row, last_of_row])) & (i >= 0)
    key = np.unique(i[fits] * (n + 1) + e[fits])
    i, e = key // (n + 1), key % (n + 1)
    owner = row[i]
    # the hash of a run: differences of a running sum of powers times word hashes, scaled back
    odd, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    count = len(found.hash)
    powers = np.cumprod(np.full(count + 1, odd, np.uint64), dtype=np.uint64)
    backs = np.cumprod(np.full(count + 1, inverse, np.uint64), dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(found.hash) * powers[:-1], dtype=np.uint64)])
    low, high = first_word[i], first_word[e]
    run = mix((total[high] - total[low]) * backs[low] + (high - low).astype(np.uint64))
    end = np.append(cut, 0)[np.minimum(e, n)]
    end = np.where(e == last_of_row[i], base[owner + 1], end)
    return owner, cut[i] - base[owner], end - base[owner], run, high - low


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _key() -> F.Column:
    """Tells different texts of one doc_id apart."""
    return F.xxhash64("text").alias("key")


def _spans(docs: DataFrame, least: int, sentences: int) -> DataFrame:
    """(doc_id, key, begin, end, span) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                row, begin, end, span, _ = spans_of(part.column("text"), least, sentences)
                at = pa.array(row)
                held = [part.column(c).take(at) for c in ("doc_id", "key")]
                yield pa.RecordBatch.from_arrays([*held, pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(span.view(np.int64))], ["doc_id", "key", "begin", "end", "span"])

    schema = with_fields([docs.schema["doc_id"]], "key bigint, begin int, end int, span bigint")
    return docs.filter("doc_id IS NOT NULL").select("doc_id", "text", _key()).mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, least: int = LEAST, sentences: int = SENTENCES) -> DataFrame:
    """(doc_id, key, cuts) of the texts with spans that occurred before; ``cuts`` are byte ranges."""
    spans, _ = written(_spans(docs.select("doc_id", "text"), least, sentences), "spans")
    place = F.struct("doc_id", "key", "begin")
    counts = spans.groupBy("span").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
    repeated, _ = written(counts.filter("first <> last").drop("last"), "repeated")
    many = max(FEW, spans.count() // HOT)
    hot = F.broadcast(repeated.filter(F.col("n") > many).drop("n"))
    others = spans.join(F.broadcast(repeated.filter(F.col("n") > many).select("span")), "span", "left_anti")
    both = others.join(repeated.filter(F.col("n") <= many).drop("n"), "span").unionByName(spans.join(hot, "span"))
    again = both.filter(F.struct("doc_id", "key", "begin") != F.col("first"))
    return again.groupBy("doc_id", "key").agg(F.collect_set(F.struct("begin", "end")).alias("cuts"))


def _joined(cuts: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted((c["begin"], c["end"]) for c in cuts):
        if out and begin <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((begin, end))
    return out


def deduplicate(docs: DataFrame, least: int = LEAST, sentences: int = SENTENCES) -> DataFrame:
    """``docs`` with repeated sentences taken out of ``text``, and a column ``removed`` with the texts taken out.

    Texts are rewritten only where something is removed.
    """
    rest = [c for c in docs.columns if c not in ("text", "removed")]
    order = [*(docs.schema[c] for c in rest), docs.schema["text"]]
    schema = with_fields(order, "removed array<string>")
    found = repeated_spans(docs.select("doc_id", "text"), least, sentences)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 22):
                texts, gone = [], []
                for text, cuts in zip(part.column("text"), part.column("cuts"), strict=True):
                    raw, at, kept, taken = text.as_py(), 0, [], []
                    if cuts.is_valid and raw is not None:
                        data = raw.encode()
                        for begin, end in _joined(cuts.as_py()):
                            kept.append(data[at:begin])
                            taken.append(data[begin:end].decode())
                            at = end
                        raw = (b"".join(kept) + data[at:]).decode()
                    texts.append(raw)
                    gone.append(taken)
                others = part.column("row").flatten() if rest else []
                yield pa.RecordBatch.from_arrays([*others, pa.array(texts, pa.string()), pa.array(gone, pa.list_(pa.string()))], schema.names)

    # other columns travel as one, so their names meet none of this step
    row = F.struct(*(F.col(_name(c)) for c in rest)).alias("row")
    held = docs.select(row, F.col("doc_id"), F.col("text"), _key())
    out = held.join(found, ["doc_id", "key"], "left").select("row", "text", "cuts").mapInArrow(run, schema)
    return out.select(*(_name(c) for c in docs.columns if c != "removed"), "removed")


def op4_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicate(docs).select("doc_id", "text", "removed", F.size("removed").cast("bigint").alias("n_removed"))


QUERIES = {"op4_repeated_spans": op4_repeated_spans}
ORACLES: dict[str, str] = {}
