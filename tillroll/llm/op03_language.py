"""Operator 3: language identification by a sparse multinomial logistic regression.

Features are character n-grams (1 to ``longest``) of the lower-cased text, hashed into ``2**bits``
buckets, with relative frequencies times inverse document frequencies.  Document frequencies are
counted over all documents that may be learned from.  The weights are fitted by follow-the-regularised-
leader with L1 and L2 penalties on a bounded sample of labelled documents (``per_label`` of each
language on average), and a temperature is fitted on another sample of that bound.  Prediction is one
narrow pass in which a text of any length costs a table look-up for each n-gram.

Edge cases: a null text or one without a letter is ``und`` with score 0; with no labelled documents at
all, everything is ``und``.  Documents with a null lang are predicted, never learned from.  Repeated
rows get equal predictions; lang, source and doc_id are no inputs of a prediction.  Texts of more than
``SAMPLE_CHARS`` characters are predicted, but the weights aren't fitted on them, so a language of such texts
only isn't learned; more than 1,000 languages raise a ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import pieces, with_fields
from tillroll.llm.wordhash import utf8

LONGEST, BITS = 3, 16
#: Bound of the labelled sample for each language, in rows; the texts of it may have ``SAMPLE_CHARS`` characters at most.
PER_LABEL, SAMPLE_CHARS = 600, 100_000
_LOW = np.arange(0x110000, dtype=np.uint32)
_LOW[:0x10000] = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in map(chr, range(0x10000))]


class Model(NamedTuple):
    labels: list[str]
    table: np.ndarray
    """A row for each bucket, a column for each language: weight times inverse document frequency."""
    bias: np.ndarray
    temperature: float


def grams(column: pa.Array, longest: int = LONGEST, bits: int = BITS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each n, the buckets of all n-grams of all texts, and where each text's begin (one more at the end)."""
    data, offsets = utf8(column)
    points = _LOW[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    length = np.diff(begins)
    out, bounds = [], []
    total = np.zeros(len(points), np.uint32)
    for n in range(1, longest + 1):
        total = total[: max(0, len(points) - n + 1)] * np.uint32(0x01000193) + points[n - 1 :] * np.uint32(0x9E3779B1)
        mixed = total ^ total >> np.uint32(15)
        bucket = (mixed * np.uint32(0x85EBCA6B) + np.uint32(n * 0x27D4EB2F)) >> np.uint32(32 - bits)
        if n > 1:  # n-grams that reach into the next text go
            keep = np.ones(len(points), bool)
            for j in range(1, n):
                keep[np.maximum(begins[1:] - j, begins[:-1])[length > 0]] = False
            bucket = bucket[keep[: len(bucket)]]
        count = np.maximum(length - n + 1, 0)
        out.append(bucket)
        bounds.append(np.concatenate([[0], np.cumsum(count)]))
    return out, bounds


def document_frequencies(docs: DataFrame, longest: int, bits: int) -> tuple[np.ndarray, int]:
    """In how many documents each bucket occurs, over all rows, and the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total, rows = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for part in pieces(batch, "text"):
                lists, bounds = grams(part.column("text"), longest, bits)
                for i in range(part.num_rows):
                    for bucket, bound in zip(lists, bounds, strict=True):
                        own = bucket[bound[i] : bound[i + 1]]
                        new = own[seen[own] != rows]
                        seen[new] = rows
                        total[new] += 1  # once each, however often it stands in new
                    rows += 1
        keep = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(keep, -1)), pa.array(np.append(total[keep], rows))], ["bucket", "n"])

    found = docs.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(1 << bits, np.int64)
    own = found[found.bucket >= 0]
    total[own.bucket.to_numpy()] = own.n.to_numpy()
    return total, int(found[found.bucket < 0].n.sum())


def _rows(texts: list[str], idf: np.ndarray, longest: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse TF-IDF rows."""
    out = []
    for text in texts:
        lists, _ = grams(pa.array([text], pa.string()), longest, bits)
        index, count = np.unique(np.concatenate(lists), return_counts=True)
        out.append((index.astype(np.int32), (count / max(1, sum(map(len, lists))) * idf[index]).astype(np.float32)))
    return out


def fit_ftrl(rows: list, target: np.ndarray, labels: int, features: int, *, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4, turns: int = 3, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, labels) and bias of a multinomial regression, one row at a time."""
    z, n = np.zeros((features + 1, labels)), np.zeros((features + 1, labels))
    order = np.random.default_rng(seed)

    def weights(index):
        zi = z[index]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[index])) / alpha + l2))

    for _ in range(turns):
        for r in order.permutation(len(rows)):
            index, value = np.append(rows[r][0], features), np.append(rows[r][1], 0.1)
            w = weights(index)
            score = value @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[target[r]] -= 1
            g = np.outer(value, p)
            z[index] += g - (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / alpha * w
            n[index] += g * g
    full = weights(np.arange(features + 1))
    return full[:-1], full[-1] * 0.1


def fit_temperature(scores: np.ndarray, target: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""

    def loss(t):
        x = scores / np.exp(t)
        x = x - x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(x)), target]).mean())

    low, high, ratio = -5.0, 3.0, (5**0.5 - 1) / 2
    while high - low > 1e-3:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(labelled: DataFrame, *, per_label: int = PER_LABEL, longest: int = LONGEST, bits: int = BITS) -> Model:
    """``labelled`` has text, lang and a column ``mark`` that orders rows at random."""
    usable = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang", "mark")
    df, total = document_frequencies(usable, longest, bits)
    idf = np.where(df > 0, np.log((1 + total) / (1 + df)) + 1, 0.0)
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"))
    if counts.count() > 1000:
        raise ValueError("more than 1000 languages to learn")
    share = 2 * per_label / F.col("n")
    chosen = usable.join(F.broadcast(counts), "lang").filter(F.pmod("mark", F.lit(1 << 20)) < share * (1 << 20)).filter(F.length("text") <= SAMPLE_CHARS)
    sample = chosen.orderBy("mark", "text").limit(3 * per_label * max(1, counts.count())).select("text", "lang", "mark").collect()
    labels = sorted({r.lang for r in sample})
    if not labels:
        return Model([], np.zeros((1 << bits, 0), np.float32), np.zeros(0), 1.0)
    target = np.array([labels.index(r.lang) for r in sample])
    rows = _rows([r.text for r in sample], idf, longest, bits)
    test = np.array([(r.mark >> 20) % 4 == 0 for r in sample]) if len(sample) > 40 else np.zeros(len(sample), bool)
    weights, bias = fit_ftrl([r for r, t in zip(rows, test, strict=True) if not t], target[~test], len(labels), 1 << bits)
    own = test if test.any() else ~test
    scores = np.array([v @ weights[i] + bias for (i, v), t in zip(rows, own, strict=True) if t])
    return Model(labels, (weights * idf[:, None]).astype(np.float32), bias, fit_temperature(scores, target[own]))


def predict(docs: DataFrame, model: Model, *, longest: int = LONGEST, bits: int = BITS, keep_text: bool = False) -> DataFrame:
    """``docs`` with lang_pred and score, with its text only if ``keep_text``; narrow."""
    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "has_letter") and (keep_text or c != "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                n, scores = part.num_rows, np.tile(model.bias, (part.num_rows, 1))
                lists, bounds = grams(part.column("text"), longest, bits)
                size = np.maximum(sum(np.diff(b) for b in bounds), 1)
                for bucket, bound in zip(lists, bounds, strict=True):
                    for c in range(len(model.labels)):
                        total = np.concatenate([[0.0], np.cumsum(model.table[bucket, c], dtype=np.float64)])
                        scores[:, c] += (total[bound[1:]] - total[bound[:-1]]) / size
                x = scores / model.temperature
                p = np.exp(x - x.max(axis=1, keepdims=True, initial=-np.inf))
                known = part.column("has_letter").to_numpy(zero_copy_only=False) & bool(model.labels)
                best = p.argmax(axis=1) if model.labels else np.zeros(n, int)
                top = p.max(axis=1, initial=0) / np.maximum(p.sum(axis=1), 1e-300)
                names = [model.labels[b] if k else "und" for b, k in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in rest] + [pa.array(names, pa.string()), pa.array(np.where(known, top, 0.0))], [*rest, "lang_pred", "score"])
        pa.default_memory_pool().release_unused()

    schema = with_fields([docs.schema[c] for c in rest], "lang_pred string, score double")
    quoted = ["`" + c.replace("`", "``") + "`" for c in rest]
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(*quoted, *["text"] * ("text" not in rest), letters.alias("has_letter")).mapInArrow(run, schema)


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")), F.lit(4)) == 2


def learn(docs: DataFrame) -> Model:
    """The model of all documents that aren't held out."""
    return fit(docs.filter(~held_out()).select("text", "lang", F.abs(F.xxhash64("doc_id")).alias("mark")))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs.select("doc_id", "text"), learn(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_language": op3_language}
ORACLES: dict[str, str] = {}
