"""Operator 11: exact Jaccard join of word shingles by rare-first prefix filtering.

A document's set is its distinct shingles of ``WORDS`` words.  Two sets are linked from a similarity of ``percent`` on.

* Documents of equal sets are one node, so copies never meet each other.
* Order: shingles are sorted by how many documents hold them, rare ones first, then by hash.  Frequencies of all documents
  are kept in ``2**SLOTS`` counters by hash, whatever the size of the corpus; a hidden collision makes a shingle look more frequent
  and costs time only, since any one order for all sets is right.
* Prefix filter: linked sets share a shingle in their first ``size - ceil(percent * size) + 1`` shingles.  Nodes meet on these.
* Length and positional filter, in the join: with the common shingle at places i and j, sets of sizes x and y
  need ``overlap = ceil(percent / (100 + percent) * (x + y))`` common ones, and at most ``min(x - i, y - j)`` are left.
* Suffix filter, before sets are fetched: the shingles fall into ``CLASSES`` classes by hash; the differences of both sets'
  class counts add up to at most the number of shingles that only one of them has, ``x + y - 2 * overlap`` if they are linked.
* Verification: each pair that is left is compared once, on the whole sets.

Pairs inside one group aren't made.  First every node is compared with one node of each token (a star), that which
shares most tokens with others, usually the text that copies were made from.  Links make components.  Then, per token,
the nodes of its most frequent component meet only those of others, so that all links between different components are found and
pairs of one component aren't looked at.  A token with many such rows is split over tasks by salt.

Edge cases: fewer than ``WORDS`` words make one shingle; null texts and texts without words have size 0 and link with nothing (their
component is their own doc_id).  ``component_id`` is the least doc_id of the component, null if it has none.  Repeated rows and
different rows of one doc_id are rows of their own; a null doc_id yields a row with the component of its text.  Empty tables give no
rows.  Only doc_id and text are read, so other columns may have any name.  Shingles are compared as 52-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import pieces, remove, with_fields, written
from tillroll.llm.graph import components
from tillroll.llm.op09_probminhash import weighted_shingles
from tillroll.llm.wordhash import NOT_SPACE, words

WORDS, PERCENT = 5, 80
#: Counters of frequencies, a power of two, cut into blocks of ``2**BLOCK``.
SLOTS, BLOCK = 22, 14
CLASSES = 64
#: Rows of a token outside its most frequent component that one task takes.
SALT = 512


def sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, offsets, node): each text's shingle hashes, sorted, and a hash of the set."""
    row, element, _ = weighted_shingles(words(texts, NOT_SPACE), len(texts), WORDS, "set")
    at = np.searchsorted(row, np.arange(len(texts) + 1))
    raw = element.tobytes()
    node = [int.from_bytes(hashlib.blake2b(raw[8 * i : 8 * j], digest_size=8).digest(), "little", signed=True) for i, j in zip(at[:-1], at[1:], strict=True)]
    return element, at, np.array(node, np.int64)


def _slot(element: np.ndarray) -> np.ndarray:
    return (element >> np.uint64(52 - SLOTS)).astype(np.int64)


def _packed(total: np.ndarray) -> pa.RecordBatch:
    """The blocks of counters that aren't all zero, compressed."""
    blocks = total.reshape(-1, 1 << BLOCK)
    some = np.flatnonzero(blocks.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([pa.compress(blocks[i].tobytes(), "zstd", asbytes=True) for i in some], pa.binary())], ["block", "counts"])


def profiles(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: (doc_id, node, size) of each document, and (block, counts) of each task's counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOTS, np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                element, at, node = sets(part.column("text"))
                np.add.at(total, _slot(element), 1)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(node), pa.array(np.diff(at)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["doc_id", "node", "size", "block", "counts"])
        held = _packed(total)
        n = held.num_rows
        yield pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *held.columns], ["doc_id", "node", "size", "block", "counts"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    return docs.select("doc_id", "text").mapInArrow(run, with_fields([docs.schema["doc_id"]], "node bigint, size bigint, block int, counts binary"))


def levels(counters: DataFrame) -> np.ndarray:
    """For each counter the logarithm of its sum over all tasks, in 16 bits.  The driver gets ``2**SLOTS`` numbers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                new = np.frombuffer(pa.decompress(counts, 8 << BLOCK, "zstd"), np.int64)
                held[block] = held[block] + new if block in held else new
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True) for x in held.values()], pa.binary())], ["block", "counts"])

    kind = "block int, counts binary"
    total = np.zeros(1 << SLOTS, np.int64)
    for row in counters.select("block", "counts").mapInArrow(add, kind).repartition("block").mapInArrow(add, kind).toLocalIterator():
        total[row.block << BLOCK : row.block + 1 << BLOCK] = np.frombuffer(pa.decompress(row.counts, 8 << BLOCK, "zstd"), np.int64)
    return np.minimum(np.log2(total + 1.0) * 1000, 65535).astype(np.uint16)


def prefixes(docs: DataFrame, level: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """(node, size, tokens, classes) of each node once: its rarest shingles, in order, and its class counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                element, at, node = sets(part.column("text"))
                size = np.diff(at)
                row = np.repeat(np.arange(len(size), dtype=np.uint64), size)
                # elements are sorted, so equal keys stay in the order of the whole hash
                order = np.argsort(row << np.uint64(52) | level[_slot(element)].astype(np.uint64) << np.uint64(36) | element >> np.uint64(16), kind="stable")
                keep = np.arange(len(element)) - np.repeat(at[:-1], size) <= np.repeat(size - -(-percent * size // 100), size)
                tokens = element[order[keep]].astype(np.uint32).view(np.int32)
                n = np.bincount(row[keep].astype(np.int64), minlength=len(size))
                classes = np.bincount(row.astype(np.int64) * CLASSES + (element >> np.uint64(20)).astype(np.int64) % CLASSES, minlength=len(size) * CLASSES)
                some = np.flatnonzero(size)
                some = some[np.unique(node[some], return_index=True)[1]]  # copies in the same part give one row
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(tokens))
                held = pa.array([c.tobytes() for c in np.minimum(classes, 255).astype(np.uint8).reshape(-1, CLASSES)[some]], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(size[some]), lists.take(pa.array(some)), held], ["node", "size", "tokens", "classes"])

    return docs.select("text").mapInArrow(run, "node bigint, size bigint, tokens array<int>, classes binary").dropDuplicates(["node"])


def fits(percent: int) -> Column:
    """Length and positional filter of two token rows (size, pos) and (size2, pos2)."""
    overlap = F.ceil(F.lit(percent) * (F.col("size") + F.col("size2")) / (100 + percent) - 1e-9)
    return (F.col("pos") + overlap <= F.col("size")) & (F.col("pos2") + overlap <= F.col("size2"))


def near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Suffix filter: the ``pairs`` (a, b) whose class counts leave a link possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, CLASSES).astype(np.int32) for c in ("cx", "cy"))
            total = batch.column("sx").to_numpy() + batch.column("sy").to_numpy()
            apart = np.abs(x - y).sum(axis=1)
            keep = apart <= total - 2 * -(-percent * total // (100 + percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    one, two = nodes.select("node", "size", "classes").toDF("a", "sx", "cx"), nodes.select("node", "size", "classes").toDF("b", "sy", "cy")
    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a bigint, b bigint")


def verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The links among ``pairs`` (a, b).  Sets are made again from one text of each node; other texts are only scanned."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = reps.join(ends, "node", "left_semi")
    ids = wanted.filter("rep IS NOT NULL").select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.join(ids, "doc_id", "left_semi").unionByName(docs.filter("doc_id IS NULL")).filter("text IS NOT NULL")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                element, at, node = sets(part.column("text"))
                raw = element.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([raw[8 * i : 8 * j] for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["node", "elements"])

    def equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    held = texts.select("text").mapInArrow(made, "node bigint, elements binary").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])
    held, held_at = written(held, "sets")
    links, _ = written(pairs.join(held.toDF("a", "x"), "a").join(held.toDF("b", "y"), "b").mapInArrow(equal, "a bigint, b bigint"), "links")
    remove(docs.sparkSession, held_at)
    return links


def _star_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """(a, b) of nodes and the head of one of their tokens."""
    degree = shared.groupBy("node").agg(F.sum("n").alias("degree"))
    heads = shared.join(degree, "node").groupBy("token").agg(F.max_by(F.struct("node", "size", "pos"), F.struct("degree", "node")).alias("h"))
    heads = heads.select("token", F.col("h.node").alias("node2"), F.col("h.size").alias("size2"), F.col("h.pos").alias("pos2"))
    pairs = shared.join(heads, "token").filter((F.col("node") != F.col("node2")) & fits(percent))
    return pairs.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def _other_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """(a, b) of nodes that share a token and have different roots; ``placed`` has token, node, size, pos and root."""
    roots = placed.groupBy("token", "root").agg(F.count("*").alias("n"))
    top = roots.groupBy("token").agg(F.max_by("root", F.struct("n", "root")).alias("top"), (F.sum("n") - F.max("n")).alias("others")).filter("others > 0")
    live, _ = written(placed.join(top, "token").withColumn("salts", F.ceil(F.col("others") / SALT).cast("int")), "live")
    one = live.filter("root <> top").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    two = live.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    two = two.select("token", "salt", *(F.col(c).alias(f"{c}2") for c in ("node", "root", "size", "pos")))
    once = (F.col("root2") == F.col("top")) | (F.col("node") < F.col("node2"))
    pairs = one.join(two, ["token", "salt"]).filter((F.col("root") != F.col("root2")) & once & fits(percent))
    return pairs.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def jaccard_components(docs: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs``."""
    docs = docs.select("doc_id", "text")
    both, _ = written(profiles(docs), "profiles")
    rows = both.filter("block IS NULL").select("doc_id", "node", "size")
    level = levels(both.filter("block IS NOT NULL"))
    reps = rows.filter("size > 0").groupBy("node").agg(F.min("doc_id").alias("rep"))
    nodes, _ = written(prefixes(docs, level, percent), "prefixes")

    tokens = nodes.select("node", "size", F.posexplode("tokens").alias("pos", "token"))
    many = tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    shared, shared_at = written(tokens.join(many, "token"), "shared")
    stars, stars_at = written(near(_star_pairs(shared, percent), nodes, percent), "stars")
    labels, labels_at = components(verified(docs, reps, stars, percent))
    placed = shared.drop("n").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    others, others_at = written(near(_other_pairs(placed, percent), nodes, percent), "others")
    gone = [shared_at, stars_at, others_at]
    if not others.isEmpty():
        found = verified(docs, reps, others, percent)
        ends = found.select("a", "b").join(labels.toDF("a", "x"), "a", "left").join(labels.toDF("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
        joined, joined_at = components(ends)
        every = labels.select("node", "root").unionByName(joined.join(labels, "node", "left_anti").select("node", F.col("node").alias("root")))
        moved, _ = written(every.join(joined.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        gone += [labels_at, joined_at]
        labels = moved
    remove(docs.sparkSession, *gone)

    whole = reps.join(labels, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    least = whole.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = whole.join(least, "root").select("node", "component_id")
    linked = rows.filter("size > 0").join(classes, "node").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    return linked.unionByName(rows.filter("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_jaccard": op11_jaccard}
_SPLIT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
#: Pairs meet on every shingle here; least neighbours are taken over until nothing changes.
ORACLES = {
    "op11_jaccard": f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS w FROM documents),
  e AS (SELECT DISTINCT r, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[p : p + 4], ' ') END AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
  n AS (SELECT r, count(*) AS n FROM e GROUP BY r),
  c AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
  l AS (SELECT x, y FROM c JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
  u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
  t AS (SELECT r AS x, r AS y FROM d UNION SELECT t.x, u.y FROM t JOIN u ON t.y = u.x),
  m AS (SELECT t.x AS r, min(d.doc_id) AS component_id FROM t JOIN d ON d.r = t.y GROUP BY t.x)
  SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM d JOIN m USING (r) LEFT JOIN n USING (r)"""
}
