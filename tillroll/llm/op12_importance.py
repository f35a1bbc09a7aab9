"""Operator 12: importance resampling towards a target distribution, over hashed word n-grams.

Each text's features (runs of ``1`` to ``most`` words) are hashed into ``buckets`` counters.  The gain of a bucket is the
log ratio of its smoothed shares among the features of the target and of the corpus; a document's weight is the
sum of gains over its features, and Gumbel noise from its doc_id turns weights into a draw without replacement.

* A document's buckets are one array, made by higher-order functions; its weight is an aggregate over
  ``element_at`` of a literal array of gains.  Nothing is exploded for scoring.
* The only corpus-wide shuffle carries counts: at most ``buckets`` partial sums of each task.  The gains, ``buckets`` numbers, are
  the only thing that goes to the driver and into the plan.
* Ranks come without a global window: scores are cut into ranges at approximate quantiles of the scores, exact counts of the
  ranges give each range its first rank, and rows are numbered inside their range.  Ranges behind the last draw aren't
  sorted at all.  Equal rows are one row with a count until they are numbered, so repeated rows make no large range.

Edge cases: null and empty texts, or texts without words, have no features, weight 0 and no rank.  A null doc_id is written as
nothing (``2024:``) in the noise and comes first among ties.  Repeated rows have ranks of their own, one after the other.
Empty tables: no documents give no rows; an empty target has t = T = 0.  Only doc_id and text of documents and text of the target are read, so
other columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm.common import written

BUCKETS, NGRAMS = 10_000, 1
SEED, LEAST_WORDS, PERCENT = "2024", 20, 10
#: Ranges for ranks: about so many drawn rows each, and so many at most.
RANGE_ROWS, RANGES = 1 << 16, 1 << 12
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def features(text: Column, most: int = NGRAMS) -> Column:
    """All runs of 1 to ``most`` words of a text, joined by one space; repeats stay."""
    words = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))
    if most == 1:
        return words
    run = lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.concat(words, *(F.when(F.size(words) >= n, run(n)).otherwise(F.array().cast("array<string>")) for n in range(2, most + 1)))


def bucketed(df: DataFrame, buckets: int = BUCKETS, most: int = NGRAMS) -> Column:
    """Each feature's bucket, as an array for each row of ``df``."""
    return F.transform(features(F.col("text"), most), lambda w: (F.crc32(w.cast("binary")) % buckets).cast("int"))


def counts(held: DataFrame, name: str) -> DataFrame:
    """(bucket, ``name``) of a table with an array column ``held``; partial sums are made before the shuffle."""
    return held.select(F.explode("held").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket; both tables have an array column ``held``."""
    rows = counts(corpus, "s").join(counts(target, "t"), "bucket", "full").select("bucket", *(F.coalesce(c, F.lit(0)).alias(c) for c in "st")).collect()
    s, t = [0] * buckets, [0] * buckets
    for row in rows:
        s[row.bucket], t[row.bucket] = row.s, row.t
    total_s, total_t = sum(s), sum(t)
    return [math.floor(1000 * math.log(((y + 1) * (total_s + buckets)) / ((x + 1) * (total_t + buckets)))) for x, y in zip(s, t, strict=True)]


def weight(held: Column, gain: list[int]) -> Column:
    """The sum of gains over an array of buckets.  One string literal is split and folded into the array."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    return F.aggregate(held, F.lit(0).cast("bigint"), lambda total, b: total + F.element_at(table, b + 1))


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise of a document, in thousandths."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("bigint")


def scored(docs: DataFrame, target: DataFrame, *, buckets: int = BUCKETS, most: int = NGRAMS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each row of ``docs``, as a table in the shared folder."""
    words = F.size("held") if most == 1 else F.size(features(F.col("text")))
    made, _ = written(docs.select("doc_id", bucketed(docs, buckets, most).alias("held"), *([] if most == 1 else [words.alias("n")])), "buckets")
    gain = gains(made, target.select(bucketed(target, buckets, most).alias("held")), buckets)
    n_words = words if most == 1 else F.col("n")
    rows = made.select("doc_id", n_words.cast("bigint").alias("n_words"), F.size("held").cast("bigint").alias("n_features"), weight(F.col("held"), gain).alias("weight"))
    return written(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")[0]


def ranked(rows: DataFrame, n: int, *, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with a column ``rank`` 1 to ``n`` by descending score, then by doc_id; the others have none.

    ``rows`` (a written table) has doc_id, score and other columns; ``eligible`` says which may be drawn.
    """
    nothing = F.lit(None).cast("bigint").alias("rank")
    names = [c for c in rows.columns if c != "eligible"]
    if n <= 0:
        return rows.select(*names, nothing)
    able = rows.filter("eligible")
    total = able.count()
    parts = min(RANGES, max(1, math.ceil(n / range_rows)))
    accuracy = 20 * parts + 1000
    # the last cut lies behind the last draw by more than the error of the quantiles
    shares = [1 - n / total * i / parts for i in range(1, parts)] + [max(0.0, 1 - n / total - 2 / accuracy)]
    cuts = sorted(set(able.agg(F.percentile_approx("score", shares, accuracy)).first()[0]), reverse=True)
    # range 0 has the scores from the first cut on, and so on
    at = sum((F.when(F.col("score") < c, 1).otherwise(0) for c in cuts), F.lit(0)) if len(cuts) <= 16 else F.aggregate(F.lit(cuts), F.lit(0), lambda k, c: k + (F.col("score") < c).cast("int"))
    ranges = able.withColumn("range", at)
    sizes = dict(ranges.groupBy("range").agg(F.count("*").alias("n")).collect())
    first, before = {}, 0
    for k in sorted(sizes):
        if before < n:
            first[k] = before
        before += sizes[k]
    last = max(first)
    start = F.element_at(F.create_map(*(F.lit(x) for pair in first.items() for x in pair)), F.col("range"))
    same = ranges.filter(F.col("range") <= last).groupBy("range", *names).agg(F.count("*").alias("copies"))
    order = Window.partitionBy("range").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), *(c for c in names if c not in ("score", "doc_id")))
    upto = start + F.sum("copies").over(order)
    placed = same.select(*names, "copies", upto.alias("upto")).withColumn("begin", F.col("upto") - F.col("copies") + 1)
    # copies are numbered in two steps, so that no array is long
    some = placed.select(*names, "upto", F.explode(F.sequence("begin", "upto", F.lit(10_000))).alias("block"))
    numbered = some.select(*names, F.explode(F.sequence("block", F.least(F.col("block") + 9_999, "upto"))).alias("rank"))
    drawn = numbered.select(*names, F.when(F.col("rank") <= n, F.col("rank")).alias("rank"))
    rest = rows.withColumn("range", at).filter(~F.col("eligible") | (F.col("range") > last)).select(*names, nothing)
    return drawn.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, most: int = NGRAMS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of ``docs``; ``rank`` is null for those not drawn."""
    rows = scored(docs, target, buckets=buckets, most=most, seed=seed)
    rows = rows.select("doc_id", "n_features", "weight", "score", (F.col("n_words") >= least_words).alias("eligible"))
    return ranked(rows, percent * rows.filter("eligible").count() // 100)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs.select("doc_id", "text"), target.select("text"))


QUERIES = {"op12_importance": op12_importance}
_SPLIT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The checksum is made of its definition: a table for each byte by eight halvings, then one step for each byte of a word.
ORACLES = {
    "op12_importance": f"""WITH k AS MATERIALIZED (SELECT list(list_reduce([b] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) r(b)),
  d AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS w FROM documents),
  x AS (SELECT r, unnest(w) AS word FROM d), y AS (SELECT unnest({_SPLIT}) AS word FROM benchmark),
  v AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM x UNION SELECT word FROM y)),
  c AS (SELECT word, xor(4294967295, list_reduce([4294967295] || list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 10000 AS bucket FROM v, k),
  s AS (SELECT bucket, count(*) AS n FROM x JOIN c USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM y JOIN c USING (word) GROUP BY bucket),
  g AS (SELECT s.bucket, floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * ((SELECT sum(n) FROM s) + 10000) AS DOUBLE) / CAST((s.n + 1) * (coalesce((SELECT sum(n) FROM t), 0) + 10000) AS DOUBLE))) AS gain FROM s LEFT JOIN t ON s.bucket = t.bucket),
  m AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM x JOIN c USING (word) JOIN g USING (bucket) GROUP BY r),
  z AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN m USING (r)),
  p AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM z)
  SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM p"""
}
