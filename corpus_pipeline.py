"""A training corpus in five stages over ``documents``; each works on what the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns documents again (the last one: token counts and ids).
Languages: documents without a letter or with a score under ``LEAST_SCORE`` go.  Near-duplicates: the
first document of each class stays.  Repeated spans: sentences go, documents stay.  Contamination:
contaminated documents go.  Empty stages give empty tables; null texts go at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import op02_decontaminate, op03_language, op04_spans, op05_bytebpe, op09_probminhash
from tillroll.llm.common import small_batches, written

LEAST_SCORE = 0.3
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = op03_language.learn(docs)
    found = op03_language.predict(docs.select("doc_id", "text", "lang", "source", "n_chars"), model, keep_text=True)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return op09_probminhash.keep_one(docs, op09_probminhash.near_duplicates(docs)).select(COLUMNS)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return op04_spans.deduplicate(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return op02_decontaminate.clean(docs.select(COLUMNS), items).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        return op05_bytebpe.encode_documents(docs, file.read(), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("language", language), ("near duplicates", near_duplicates), ("repeated spans", repeated_spans), ("decontaminate", decontaminate), ("encode", encode)]

#: No stage is expressible in SQL; the operators are held against brute force, round trips or accuracy in their own tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
