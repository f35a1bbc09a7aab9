"""Operator 2: benchmark decontamination by a prefix-filtered set join.

Each benchmark item yields windows of ``size`` consecutive words (an item of fewer words is one
window).  A window is an ordered set of word shingles that a document must contain whole, so the
prefix that the join needs is one shingle: the rarest one in the corpus.  One pass over the documents
counts how often each benchmark shingle occurs there; a second pass joins each window's rarest shingle
with the document's shingles.  A hit at some position fixes where the window would begin; windows
that would begin before the text or end behind it are pruned (length and positional bounds), the rest
are compared by the hashes of all words and then word by word.

The benchmark is taken in blocks of ``block`` bytes of text, so what the driver and a task hold has a
fixed bound; each block costs two scans of the documents, and hits of several blocks are written and
meet per document, none of them being dropped.

Edge cases: null and empty texts have no words, are never contaminated and count 0 words; items
without words yield no window; equal items all count; repeated rows of a doc_id are rows of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import pieces, with_fields, written
from tillroll.llm.wordhash import LOWER, Words, shingles, words

SIZE = 13
SHINGLE = 3
#: Bytes of benchmark text in a block.
BLOCK = 4_000_000


class Windows(NamedTuple):
    """Distinct windows of a block of items, as places in the block's words."""

    split: Words
    first: np.ndarray
    """Number of the window's first word."""
    length: np.ndarray
    holders: np.ndarray
    """Items of all windows, window by window; those of window i are ``holders[at[i] : at[i + 1]]``."""
    at: np.ndarray
    items: list[str]


def windows_of(rows: list[tuple], size: int) -> Windows:
    """Distinct windows of (item_id, text) rows, each with the items that have it; windows are equal if 64-bit hashes of their words are."""
    split = words(pa.array([text for _, text in rows], pa.string()))
    sizes = np.diff(split.bounds())
    names = sorted({str(item) for item, _ in rows})
    number = {name: i for i, name in enumerate(names)}
    item = np.array([number[str(i)] for i, _ in rows], np.int64)
    first, length, window, holder = [], [], [], []
    made = 0
    for n in np.unique(np.minimum(sizes[sizes > 0], size)).tolist():
        at, hashes = shingles(split, n)
        if n < size:
            whole = sizes[split.row[at]] == n
            at, hashes = at[whole], hashes[whole]
        _, one, group = np.unique(hashes, return_index=True, return_inverse=True)
        first.append(at[one])
        length.append(np.full(len(one), n))
        window.append(group.ravel() + made)
        holder.append(item[split.row[at]])
        made += len(one)
    if not made:
        none = np.zeros(0, np.int64)
        return Windows(split, none, none, none, np.zeros(1, np.int64), names)
    pairs = np.unique(np.stack([np.concatenate(window), np.concatenate(holder)]), axis=1)
    return Windows(split, np.concatenate(first), np.concatenate(length), pairs[1], np.searchsorted(pairs[0], np.arange(made + 1)), names)


def tokens_of(found: Windows, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows whose shingles have ``k`` words, and the hash of the shingle at each word of the block (0 where there is none)."""
    own = np.flatnonzero(np.minimum(found.length, SHINGLE) == k)
    at, hashes = shingles(found.split, k)
    token = np.zeros(len(found.split.hash), np.uint64)
    token[at] = hashes
    return own, token


class Members:
    """Which of many 64-bit hashes are in a small set: a table of bits first, then a search."""

    BITS = 20

    def __init__(self, hashes) -> None:
        self.sorted = np.unique(np.array(list(hashes), np.uint64))
        self.bits = np.zeros(1 << self.BITS, bool)
        self.bits[(self.sorted >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the members among ``hashes`` and their places in ``sorted``."""
        at = np.flatnonzero(self.bits[(hashes >> np.uint64(64 - self.BITS)).astype(np.int64)])
        if not len(at) or not len(self.sorted):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.sorted, hashes[at]), len(self.sorted) - 1)
        same = self.sorted[place] == hashes[at]
        return at[same], place[same]


def rarity(docs: DataFrame, found: Windows) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """How often each shingle of the windows occurs in all documents, as sorted shingles and counts by their number of words."""
    kinds = {}
    for k in range(1, SHINGLE + 1):
        own, token = tokens_of(found, k)
        if len(own):
            inside = np.zeros(len(token), bool)
            for j in range(int(found.length[own].max()) - k + 1):
                inside[found.first[own[found.length[own] - k >= j]] + j] = True
            kinds[k] = Members(token[inside])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {k: np.zeros(len(m.sorted), np.int64) for k, m in kinds.items()}
        for batch in batches:
            for part in pieces(batch, "text"):
                split = words(part.column("text"))
                for k, members in kinds.items():
                    _, place = members.find(shingles(split, k)[1])
                    totals[k] += np.bincount(place, minlength=len(totals[k]))
        for k, total in totals.items():
            keep = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), k, np.int32)), pa.array(keep), pa.array(total[keep])], ["k", "place", "n"])

    # a row for each distinct shingle of the block at most
    counts = docs.select("text").mapInArrow(run, "k int, place bigint, n bigint").groupBy("k", "place").agg(F.sum("n").alias("n")).toPandas()
    out = {}
    for k, members in kinds.items():
        total, own = np.zeros(len(members.sorted), np.int64), counts[counts["k"] == k]
        total[own["place"].to_numpy(np.int64)] = own["n"].to_numpy(np.int64)
        out[k] = members.sorted, total
    return out


class Prefixes(NamedTuple):
    """The rarest shingle of each window of one shingle size: shingles, and the windows of each with their offsets."""

    members: Members
    at: np.ndarray
    window: np.ndarray
    offset: np.ndarray


def prefixes_of(found: Windows, counts: dict) -> dict[int, Prefixes]:
    out = {}
    for k, (tokens, total) in counts.items():
        own, token = tokens_of(found, k)
        offset, least, chosen = np.zeros(len(own), np.int64), np.full(len(own), np.iinfo(np.int64).max), np.zeros(len(own), np.uint64)
        for j in range(int(found.length[own].max()) - k + 1):
            fits = np.flatnonzero(found.length[own] - k >= j)
            here = token[found.first[own[fits]] + j]
            n = total[np.searchsorted(tokens, here)]
            better = n < least[fits]
            fits = fits[better]
            offset[fits], least[fits], chosen[fits] = j, n[better], here[better]
        seen = np.flatnonzero(least > 0)  # a window with a shingle that occurs nowhere is in no document
        order = seen[np.argsort(chosen[seen], kind="stable")]
        members = Members(chosen[order])
        out[k] = Prefixes(members, np.searchsorted(chosen[order], np.append(members.sorted, np.uint64(2**64 - 1))), own[order], offset[order])
        out[k].at[-1] = len(order)
    return out


def _candidates(split: Words, found: Windows, by_size: dict[int, Prefixes]) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) where a window's rarest shingle occurs, its place fits the text and all words have equal hashes."""
    bounds, begins, windows = split.bounds(), [], []
    for k, prefix in by_size.items():
        at, token = shingles(split, k)
        index, place = prefix.members.find(token)
        n = prefix.at[place + 1] - prefix.at[place]
        entry = np.repeat(prefix.at[place] - np.cumsum(n) + n, n) + np.arange(n.sum())
        position, window = np.repeat(at[index], n), prefix.window[entry]
        begin, row = position - prefix.offset[entry], split.row[position]
        fits = (begin >= bounds[row]) & (begin + found.length[window] <= bounds[row + 1])
        begin, window = begin[fits], window[fits]
        for j in range(int(found.length[window].max(initial=0))):
            longer = np.flatnonzero(found.length[window] > j)
            wrong = longer[split.hash[begin[longer] + j] != found.split.hash[found.first[window[longer]] + j]]
            begin, window = np.delete(begin, wrong), np.delete(window, wrong)
        begins.append(begin)
        windows.append(window)
    return (np.concatenate(begins), np.concatenate(windows)) if begins else (np.zeros(0, np.int64),) * 2


def hits(docs: DataFrame, found: Windows, counts: dict) -> DataFrame:
    """Each document row's number of words, disjoint spans of hit words and items; narrow."""
    by_size = prefixes_of(found, counts)
    # only words, windows and items go to the tasks: their size is that of the block
    low = LOWER[found.split.data]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                split = words(part.column("text"))
                bounds = split.bounds()
                marks = np.zeros(len(split.hash) + 1, np.int64)
                holders: dict[int, set] = {}
                for begin, window in zip(*(x.tolist() for x in _candidates(split, found, by_size)), strict=True):
                    one, n = int(found.first[window]), int(found.length[window])
                    if all(LOWER[split.data[split.begin[begin + j] : split.end[begin + j]]].tobytes() == low[found.split.begin[one + j] : found.split.end[one + j]].tobytes() for j in range(n)):
                        marks[begin] += 1
                        marks[begin + n] -= 1
                        holders.setdefault(int(split.row[begin]), set()).update(found.holders[found.at[window] : found.at[window + 1]].tolist())
                edges = np.diff((np.cumsum(marks) > 0).astype(np.int8), prepend=0)
                begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
                spans: dict[int, list] = {}
                for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
                    for row in range(split.row[begin], split.row[end - 1] + 1):  # texts may touch
                        first, last = max(begin, bounds[row]), min(end, bounds[row + 1])
                        if first < last:
                            spans.setdefault(row, []).append({"begin": first - bounds[row], "end": last - bounds[row]})
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("digest"), pa.array(np.diff(bounds), pa.int64()),
                        pa.array([spans.get(i, []) for i in range(n)], pa.list_(pa.struct({"begin": pa.int64(), "end": pa.int64()}))),
                        pa.array([[found.items[h] for h in sorted(holders.get(i, ()))] for i in range(n)], pa.list_(pa.string())),
                    ],
                    ["doc_id", "digest", "n_words", "spans", "items"],
                )

    schema = with_fields([docs.schema["doc_id"]], "digest string, n_words bigint, spans array<struct<begin:bigint,end:bigint>>, items array<string>")
    return docs.select("doc_id", "text", "digest").mapInArrow(run, schema)


def blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple]]:
    """Rows of the benchmark in runs of about ``most`` bytes of text."""
    block, held = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        block.append(tuple(row))
        held += len(row.text or "")
        if held >= most:
            yield block
            block, held = [], 0
    yield block


def _covered(spans: Column) -> Column:
    """Number of words in the union of the spans."""
    step = lambda a, x: F.struct(
        (a.n + F.greatest(F.lit(0), x.end - F.greatest(x.begin, a.upto))).alias("n"), F.greatest(a.upto, x.end).alias("upto")
    )
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto"))
    return F.aggregate(F.array_sort(spans), start, step, lambda a: a.n)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document row: n_words, n_hit, items (ids of the items with occurring windows, sorted as
    strings) and ``contaminated`` (some word is hit, and hit words * ``share`` reach n_words).
    """
    return _judged(docs, benchmark, F.lit(None), **options).drop("digest")


def _judged(docs: DataFrame, benchmark: DataFrame, digest: Column, *, size: int = SIZE, share: int = 20, block: int = BLOCK) -> DataFrame:
    """:func:`decontaminate` with a ``digest`` of each text, which may be null where one block of the benchmark suffices."""
    parts = blocks(benchmark, block)
    first, second = next(parts), next(parts, None)
    plain = docs.withColumn("digest", digest.cast("string"))
    if second is None:
        found = windows_of(first, size)
        out = hits(plain, found, rarity(docs, found) if len(found.first) else {})
    else:
        keyed, tables = docs.withColumn("digest", _digest()), []
        for rows in chain([first, second], parts):
            found = windows_of(rows, size)
            tables.append(written(hits(keyed, found, rarity(docs, found)).filter(F.size("spans") > 0).dropDuplicates(["doc_id", "digest"]), "hits")[0])
        merged = reduce(DataFrame.unionByName, tables).groupBy("doc_id", "digest").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        rest = hits(keyed, windows_of([], size), {}).select("doc_id", "digest", "n_words")
        same = rest["doc_id"].eqNullSafe(merged["doc_id"]) & (rest["digest"] == merged["digest"])
        out = rest.join(merged, same, "left").select(rest["doc_id"], rest["digest"], "n_words", "spans", "items").withColumns({c: F.coalesce(c, F.array().cast(merged.schema[c].dataType)) for c in ("spans", "items")})
    out = out.select("doc_id", "digest", "n_words", _covered(F.col("spans")).alias("n_hit"), "items")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def _digest() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without contaminated rows: few keys are joined, the texts stay in place where Spark
    finds them few enough to broadcast.  Rows go by doc_id (nulls alike) and text, so of different texts of one doc_id
    only the contaminated ones go, and all rows of a contaminated text under one doc_id."""
    bad = _judged(docs.select("doc_id", "text"), benchmark, _digest(), **options).filter("contaminated").select(F.col("doc_id").alias("bad_id"), "digest").distinct()
    # the digest's name must not clash with a column of docs
    name = "_" * (max(map(len, docs.columns)) + 1)
    keyed = docs.withColumn(name, _digest())
    return keyed.join(bad, (keyed[name] == bad["digest"]) & keyed["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti").drop(name)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def brute_force(texts: dict, items: dict, size: int = SIZE) -> dict:
    """What op2 has to return, by comparing every position of every text with every window."""
    import re

    def split(text):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)

    out = {}
    for doc, text in texts.items():
        w, hit, held = split(text), set(), set()
        for item, it in items.items():
            v = split(it)
            n = min(size, len(v))
            for i in range(len(v) - n + 1) if n else ():
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[i : i + n]:
                        hit.update(range(j, j + n))
                        held.add(str(item))
        digest = hashlib.sha256(",".join(sorted(held)).encode()).hexdigest()
        out[doc] = len(w), len(hit), len(held), digest, bool(hit) and 20 * len(hit) >= len(w)
    return out


QUERIES = {"op2_decontaminate": op2_decontaminate}
_SPLIT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES = {
    "op2_decontaminate": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS w FROM documents),
  i AS (SELECT CAST(item_id AS VARCHAR) AS item, v, least(13, len(v)) AS n FROM (SELECT item_id, {_SPLIT} AS v FROM benchmark) WHERE len(v) > 0),
  s AS (SELECT DISTINCT item, n, array_to_string(v[p : p + n - 1], ' ') AS k FROM (SELECT item, n, v, unnest(range(1, len(v) - n + 2)) AS p FROM i)),
  x AS (SELECT r, p, n, array_to_string(w[p : p + n - 1], ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM i))),
  h AS (SELECT r, p, x.n, item FROM x JOIN s ON x.k = s.k AND x.n = s.n),
  c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM h)) GROUP BY r),
  g AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
  SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
  FROM d LEFT JOIN c USING (r) LEFT JOIN g USING (r)"""
}
