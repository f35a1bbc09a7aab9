"""Operator 9: near-duplicate classes by ProbMinHash, banding and exact verification.

Each shingle of a text with weight w is a Poisson process of rate w; an arrival falls on a random
register, and a register keeps the shingle that arrived first.  A shingle stops as soon as its next
arrival lies behind all registers of its text.  Two texts agree in a register with a probability that
is their probability Jaccard similarity.  Texts that agree in all registers of some band share a bucket;
similarity is then computed exactly from their shingles.

* Texts of equal words are one node, whose representative stands for all copies.
* In a bucket each node is compared with one node only (a star), that which shares most buckets with
  others, usually the text that the copies were made from; connected components follow.
* A bucket whose nodes still lie in different components may hold links off the star.  Its nodes (the
  residue) meet by an exact prefix filter: of each text the rarest shingles that hold ``1 - least`` of its
  weight and one more; a pair of that similarity has a shingle in common there, and its places in both
  texts must leave enough weight behind (see :func:`prefixes`).  So nothing is lost, and pairs of one
  component are not made: of a shingle's rows, those of its most frequent component meet only the others.
* ``weight`` is ``count`` (a shingle weighs as often as it occurs) or ``set`` (each weighs 1; the
  similarity is then the plain Jaccard similarity).

A band of ``ROWS`` registers in ``BANDS`` bands misses a pair of similarity 0.8 with a probability of
(1 - 0.8^5)^28 = 1.5e-5; nothing behind the bands loses pairs.  Shingle hashes in verification have 32
bits, which moves a similarity by less than 1e-5 in texts of 20,000 words.

Edge cases: a text of one to four words is one shingle; texts without words are classed by their
exact text, null ones by nothing (each is its own class).  Repeated rows share a class.  ``class_id``
is the least doc_id of the class.  A null doc_id yields a row with the class of its text.  Different texts of one
doc_id are rows of their own, told apart by ``key``; ``group`` tells classes apart even then.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import pieces, remove, with_fields, written
from tillroll.llm.graph import components
from tillroll.llm.wordhash import Words, mix, one_run, shingles, words

WORDS, SIMILARITY = 5, 0.8
ROWS, BANDS = 5, 28
REGISTERS = ROWS * BANDS
#: Counters of shingle frequencies in the residue, a power of two; they order shingles, so collisions cost time only.
COUNTERS = 20
#: Counters go from task to task and to the driver in compressed blocks of ``2**BLOCK``, never as rows.
BLOCK = 12
#: Rows of one shingle on either side of the residue's join that meet in one group; a shingle of more rows is split into a grid of groups.
SPLIT = 4096


def weighted_shingles(found: Words, n: int, k: int = WORDS, weight: str = "count") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, 52-bit hash, weight) of the distinct shingles of each of ``n`` <= 4096 texts, sorted."""
    at, hashes = shingles(found, k)
    row = found.row[at]
    spans = found.bounds()
    size = np.diff(spans)
    few = np.flatnonzero((size > 0) & (size < k))
    if len(few):
        row = np.concatenate([row, few])
        hashes = np.concatenate([hashes, np.array([one_run(found.hash[spans[i] : spans[i + 1]]) for i in few], np.uint64)])
    key = np.sort(row.astype(np.uint64) << np.uint64(52) | hashes >> np.uint64(12))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(first)
    count = np.diff(np.append(begin, len(key))).astype(np.float64)
    key = key[begin]
    return (key >> np.uint64(52)).astype(np.int64), key & np.uint64((1 << 52) - 1), count if weight == "count" else np.ones(len(key))


def registers(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """ProbMinHash signatures of ``n`` weighted sets as an array (n, m); 0 where a set is empty."""
    time, kept = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    base, now, turn = row * m, np.zeros(len(row)), 0
    while len(row):
        turn += 1
        random = mix(element + np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        now = now - np.log1p((random >> np.uint64(12)).astype(float) * -(2.0**-52)) / weight
        slot = base + (mix(random) % np.uint64(m)).astype(np.int64)
        better = np.flatnonzero(now < time[slot])
        place, when = slot[better], now[better]
        np.minimum.at(time, place, when)
        won = time[place] == when
        kept[place[won]] = element[better[won]]
        live = row[np.flatnonzero(np.diff(row, prepend=-1))]
        last = np.empty(n)
        last[live] = time.reshape(n, m)[live].max(axis=1)
        alive = np.flatnonzero(now < last[row])
        row, element, weight, base, now = row[alive], element[alive], weight[alive], base[alive], now[alive]
    return kept.reshape(n, m)


def band_hashes(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit bucket for each band of each signature."""
    n, m = signature.shape
    parts = signature.reshape(n, m // rows, rows)
    total = np.broadcast_to(np.arange(1, m // rows + 1, dtype=np.uint64), (n, m // rows)).copy()
    for j in range(rows):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return total


def _nodes(found: Words, texts: pa.Array) -> np.ndarray:
    """A 64-bit hash of each text's words, or of the raw text where it has none."""
    spans, out = found.bounds(), []
    raw = found.hash.tobytes()
    for i in range(len(texts)):
        held = raw[8 * spans[i] : 8 * spans[i + 1]] or b"\0" + (texts[i].as_py() or "").encode()
        out.append(int.from_bytes(hashlib.blake2b(held, digest_size=8).digest(), "little", signed=True))
    return np.array(out, np.int64)


def signatures(docs: DataFrame, weight: str) -> DataFrame:
    """(doc_id, key, node, bands) of each row; ``bands`` is empty where a text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                found, n = words(part.column("text")), part.num_rows
                row, element, weights = weighted_shingles(found, n, weight=weight)
                bands = band_hashes(registers(row, element, weights, n)).view(np.int64)
                has = np.zeros(n, bool)
                has[row] = True
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32), pa.array(bands[has].ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(_nodes(found, part.column("text"))), lists], ["doc_id", "key", "node", "bands"])

    schema = with_fields([docs.schema["doc_id"]], "key bigint, node bigint, bands array<bigint>")
    return docs.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(run, schema)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Of two weighted sets with sorted distinct elements ``a``, ``b`` and weights ``x``, ``y``."""
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = x / x.sum(), y / y.sum()
    u, v = x[i], y[j]
    order = np.argsort(u / v)
    u, v = u[order], v[order]
    # elements of one set only have the ratio infinity or 0 and always count on their own side
    below = np.concatenate([[0.0], np.cumsum(v)])[:-1] + (1 - v.sum())
    above = 1 - np.concatenate([[0.0], np.cumsum(u)])[:-1]
    return float((1 / (above / u + below / v)).sum())


def shingle_table(docs: DataFrame, reps: DataFrame, nodes: DataFrame, weight: str) -> DataFrame:
    """(node, elements, weights) of each of ``nodes`` once, as bytes of sorted 32-bit hashes and of weights (none where all are 1)."""
    wanted = reps.join(nodes, "node", "left_semi")
    ids = wanted.filter("rep IS NOT NULL").select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.join(ids, "doc_id", "left_semi").unionByName(docs.filter("doc_id IS NULL")).filter("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                found, n = words(part.column("text")), part.num_rows
                row, element, weights = weighted_shingles(found, n, weight=weight)
                spans = np.searchsorted(row, np.arange(n + 1))
                short = (element >> np.uint64(20)).astype("<u4")
                elements, heavy = [], []
                for i, j in zip(spans[:-1], spans[1:], strict=True):
                    own, first = np.unique(short[i:j], return_index=True)
                    ones = weights[i:j][first].astype("<u4")
                    elements.append(own.tobytes())
                    heavy.append(ones.tobytes() if (ones != 1).any() else b"")
                yield pa.RecordBatch.from_arrays([pa.array(_nodes(found, part.column("text"))), pa.array(elements, pa.binary()), pa.array(heavy, pa.binary())], ["node", "elements", "weights"])

    made = texts.select("text").mapInArrow(run, "node bigint, elements binary, weights binary")
    return made.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _set(elements: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(elements, "<u4")
    return own, np.frombuffer(weights, "<u4").astype(float) if weights else np.ones(len(own))


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose exact similarity is ``least`` or more, up to rounding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("elements", "weights", "other", "other_weights")]
            keep = [probability_jaccard(*_set(e, w), *_set(f, v)) >= least - 1e-9 for e, w, f, v in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("node").alias("a"), "elements", "weights")
    two = sets.select(F.col("node").alias("b"), F.col("elements").alias("other"), F.col("weights").alias("other_weights"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a bigint, b bigint")


def _packed(blocks: dict[int, np.ndarray]) -> pa.RecordBatch:
    """A row for each block of counters, compressed."""
    return pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True) for x in blocks.values()], pa.binary())], ["block", "counts"])


def _unpacked(counts: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(counts, 8 << BLOCK, "zstd"), np.int64)


def counters(sets: DataFrame) -> DataFrame:
    """(block, counts) of the ``2**COUNTERS`` counters of shingles by their hash, over all of ``sets``; blocks of zeros are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << COUNTERS - BLOCK, 1 << BLOCK), np.int64)
        for batch in batches:
            for held in batch.column("elements").to_pylist():
                np.add.at(total.reshape(-1), np.frombuffer(held, "<u4") >> np.uint32(32 - COUNTERS), 1)
        yield _packed({int(i): total[i] for i in np.flatnonzero(total.any(axis=1))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                held[block] = held.get(block, 0) + _unpacked(counts)
        yield _packed(held)

    kind = "block int, counts binary"
    return sets.select("elements").mapInArrow(run, kind).repartition("block").mapInArrow(add, kind)


def frequencies(sets: DataFrame) -> np.ndarray:
    """In about how many of ``sets`` a shingle occurs, whatever the number of sets.

    The driver gets at most ``2**(COUNTERS - BLOCK)`` rows of ``8 << BLOCK`` bytes before compression (8 MB) and keeps 4 MB.
    """
    total = np.zeros(1 << COUNTERS, np.uint32)
    for row in counters(sets).collect():
        total[row.block << BLOCK : row.block + 1 << BLOCK] = np.minimum(_unpacked(row.counts), (1 << 32) - 1)
    return total


def prefixes(sets: DataFrame, counts: np.ndarray, least: float) -> DataFrame:
    """(token, node, root, rest, size) for the tokens of each set's prefix that some other set may have.

    Shingles are ordered by their counts, then by hash.  ``rest`` is the share of weight from this shingle on.  If x and y have
    the shares a and b of their weight in common, their similarity is at most 1 / (1/a + 1/b - 1).  At their first
    common shingle a and b are at most the rests, so both are ``least`` or more (the shingle is in both
    prefixes) and 1/rest + 1/rest' is at most 1 + 1/least.  ``size`` is the number of shingles if all weigh 1, else 0:
    between two such sets the weights in common are equal too, which bounds them by both sizes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("node", "root", "elements", "weights")), strict=True)
            for node, root, elements, heavy in rows:
                own, weights = _set(elements, heavy)
                count = counts[own >> np.uint32(32 - COUNTERS)]
                order = np.lexsort((own, count))
                rest = 1 - np.concatenate([[0.0], np.cumsum(weights[order])[:-1]]) / weights.sum()
                order, rest = order[keep := (rest >= least - 1e-9) & (count[order] > 1)], rest[keep]
                out.append((own[order].astype(np.int64), np.full(len(order), node), np.full(len(order), root), rest, np.full(len(order), 0 if heavy else len(own), np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["token", "node", "root", "rest", "size"])

    return sets.select("node", "root", "elements", "weights").mapInArrow(run, "token bigint, node bigint, root bigint, rest double, size int")


def off_star_pairs(residue: DataFrame, least: float, split: int = SPLIT) -> DataFrame:
    """(a, b) of different roots that may be similar; ``residue`` has node, root, elements and weights.

    No group of the join has more than about ``split`` rows on a side, however many texts share a shingle.
    """
    tokens, _ = written(prefixes(residue, frequencies(residue), least), "prefixes")
    # per token the root of most rows; its rows meet only those of other roots, so no pairs of one large component are looked at
    roots = tokens.groupBy("token", "root").agg(F.count("*").alias("n"))
    strips = lambda n: F.ceil(n / split).cast("int")
    tops = roots.groupBy("token").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.count("*").alias("roots"), F.sum("n").alias("n"), F.max("n").alias("most"))
    top = tops.filter("roots > 1").select("token", "top", strips(F.col("n") - F.col("most")).alias("rows"), strips(F.col("n")).alias("columns"))
    live, live_at = written(tokens.join(top, "token"), "prefixes")
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = live.filter("root <> top").withColumn("i", part("rows")).withColumn("j", every("columns"))
    two = live.withColumn("j", part("columns")).withColumn("i", every("rows")).select("token", "i", "j", *(F.col(c).alias(f"{c}2") for c in ("node", "root", "rest", "size")))
    once = (F.col("root2") == F.col("top")) | (F.col("node") < F.col("node2"))
    shares = 1 / F.col("rest") + 1 / F.col("rest2") <= 1 + 1 / least + 1e-9
    common = F.least(F.col("rest") * F.col("size"), F.col("rest2") * F.col("size2"))
    sizes = (F.col("size") == 0) | (F.col("size2") == 0) | (common >= least / (1 + least) * (F.col("size") + F.col("size2")) - 1e-6)
    pairs = one.join(two, ["token", "i", "j"]).filter((F.col("root") != F.col("root2")) & once & shares & sizes)
    return pairs.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, least: float = SIMILARITY, weight: str = "count") -> DataFrame:
    """(doc_id, class_id, key, group, kept) of each row of ``docs``; only doc_id and text are read.

    ``key`` is a hash of the text; ``kept`` marks the rows of the class's least (doc_id, key).
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    rows, _ = written(signatures(docs.filter("text IS NOT NULL"), weight), "signatures")
    place = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key"))
    reps, _ = written(rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min(place).alias("first"), F.first("bands").alias("bands")), "nodes")

    members = reps.select("node", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared, shared_at = written(members.join(sizes, "bucket"), "shared")
    degree = shared.groupBy("node").agg(F.sum("n").alias("degree"))
    sets, sets_at = written(shingle_table(docs, reps, degree.select("node"), weight), "sets")
    ranked = shared.join(degree, "node")
    heads = ranked.groupBy("bucket").agg(F.max_by("node", F.struct("degree", "node")).alias("head"))
    stars, stars_at = written(shared.join(heads, "bucket"), "stars")
    pairs, pairs_at = written(stars.filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links, links_at = written(verified(pairs, sets, least), "links")
    labels, labels_at = components(links)

    placed = stars.filter("n > 2").join(labels, "node", "left").select("bucket", "node", "head", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s").select("bucket")
    off_star = placed.join(mixed, "bucket", "left_semi").filter("node <> head").select("node", "root").distinct()
    residue, residue_at = written(sets.join(off_star, "node"), "residue")
    gone = [shared_at, sets_at, stars_at, pairs_at, links_at, residue_at]
    if not residue.isEmpty():
        more, more_at = written(off_star_pairs(residue, least), "pairs")
        found, found_at = written(verified(more, sets, least), "links")
        gone += [more_at, found_at]
        if not found.isEmpty():
            root = residue.select("node", "root")
            ends = found.join(root.toDF("a", "x"), "a").join(root.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
            joined, joined_at = components(ends)
            every = labels.select("node", "root").unionByName(root).distinct()
            moved = every.join(joined.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            gone += [labels_at, joined_at]
            labels, _ = written(moved, "labels")
    remove(spark, *gone)

    whole = reps.join(labels, "node", "left").select("node", "rep", "first", F.coalesce("root", "node").alias("group"))
    least_id = whole.groupBy("group").agg(F.min("rep").alias("class_id"), F.min(F.when(F.col("first").isNotNull(), F.col("first"))).alias("least"))
    classes = whole.join(least_id, "group").select("node", "group", "class_id", "least")
    kept = F.coalesce(F.struct("doc_id", "key") == F.col("least"), F.lit(False))
    alone = docs.filter("text IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(None).cast("bigint").alias("key"), F.lit(None).cast("bigint").alias("group"), F.lit(True).alias("kept"))
    return rows.join(classes, "node").select("doc_id", "class_id", "key", "group", kept.alias("kept")).unionByName(alone)


def keep_one(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class, that of its least (doc_id, key); rows of a null doc_id or text stay.

    Different texts of one doc_id are documents of their own; repeated rows of one doc_id and text are one.
    """
    columns = docs.columns
    marks = classes.filter("doc_id IS NOT NULL AND key IS NOT NULL").groupBy("doc_id", "key").agg(F.first("kept").alias("kept"), F.count("*").alias("n"))
    marks, _ = written(marks, "marks")
    # the key's name must not clash with a column of docs
    name = "_" * (max(map(len, columns)) + 1)
    keyed = docs.withColumn(name, F.when(F.col("doc_id").isNotNull(), F.xxhash64("text")))
    left = keyed.join(marks.filter("NOT kept").select("doc_id", F.col("key").alias(name)), ["doc_id", name], "left_anti")
    twice = marks.filter("kept AND n > 1").select("doc_id", F.col("key").alias(name))
    if not twice.isEmpty():
        left = left.join(twice, ["doc_id", name], "left_anti").unionByName(left.join(twice, ["doc_id", name], "left_semi").dropDuplicates(["doc_id", name]))
    return left.select(columns)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "kept")


QUERIES = {"op9_near_duplicates": op9_near_duplicates}
ORACLES: dict[str, str] = {}
