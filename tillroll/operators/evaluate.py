"""Accuracy of extraction and of duplicate detection against labelled data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.fuzzy import similarity


def amount_accuracy(readings: DataFrame, truth: DataFrame) -> DataFrame:
    """E-01, A-13, J-07: correct, wrong and unreadable totals; both sides by ``name``."""
    rows = readings.join(truth, "name")
    right = F.abs(F.col("total_amount") - F.col("expected_total")) <= 0.01
    return rows.agg(F.count("*").alias("n"), F.count_if(right).alias("correct"), F.count_if(~right).alias("wrong"), F.count_if(F.col("total_amount").isNull()).alias("unreadable"))


def field_accuracy(readings: DataFrame, truth: DataFrame) -> DataFrame:
    """E-02: dates exact, times to the minute, at least one reference, merchant codes."""
    r = readings.join(truth.select("name", F.col("receipt_date").alias("true_date"), F.col("receipt_time_s").alias("true_time"), F.col("reference_codes").alias("true_codes"), F.col("merchant_code").alias("true_merchant")), "name")
    minute = lambda c: F.floor(F.col(c) / 60)
    return r.agg(
        F.count("*").alias("n"), F.count_if(F.col("receipt_date") == F.col("true_date")).alias("dates"), F.count_if(minute("receipt_time_s") == minute("true_time")).alias("times"),
        F.count_if(F.arrays_overlap("reference_codes", "true_codes")).alias("with_reference"), F.count_if(F.col("merchant_code") == F.col("true_merchant")).alias("merchants"),
    )


def dedup_confusion(decisions: DataFrame, truth: DataFrame) -> DataFrame:
    """E-03, A-14, J-09: caught, missed and over-blocked duplicates.

    ``decisions`` (id, accepted); ``truth`` (id, purchase).  A row is a duplicate if an accepted row of
    the same purchase came before it.
    """
    rows = decisions.join(truth, "id")
    first = rows.filter("accepted").groupBy("purchase").agg(F.min("id").alias("first"))
    known = rows.join(first, "purchase", "left").withColumn("repeat", F.coalesce(F.col("id") > F.col("first"), F.lit(False)))
    return known.agg(
        F.count_if(F.col("repeat") & ~F.col("accepted")).alias("caught"), F.count_if(F.col("repeat") & F.col("accepted")).alias("missed"), F.count_if(~F.col("repeat") & ~F.col("accepted")).alias("over_blocked")
    )


def item_accuracy(got: DataFrame, expected: DataFrame, least: float = 0.6) -> DataFrame:
    """E-04, J-08: for each receipt whether the counts agree and how many expected names have a similar one.

    ``got`` and ``expected``: (name, items array of name and price).  Names meet inside a receipt only;
    pairs with too few letters in common for ``least`` are ruled out natively.
    """
    rows = got.select("name", F.col("items").alias("g")).join(expected.select("name", F.col("items").alias("e")), "name")
    pairs = rows.select("name", F.posexplode("e").alias("k", "x"), "g").select("name", "k", "x", F.explode_outer("g").alias("y"))
    x, y = F.col("x.name"), F.col("y.name")
    common = F.length(x) - F.length(F.call_function("translate", x, y, F.lit("")))
    pairs = pairs.filter((2 * common >= least * (F.length(x) + F.length(y))) | (F.length(x) + F.length(y) == 0))
    best = pairs.withColumn("s", F.coalesce(similarity(x, y), F.lit(0.0))).groupBy("name", "k").agg(F.max("s").alias("s"))
    similar = best.groupBy("name").agg(F.count_if(F.col("s") >= least).alias("similar"))
    return rows.select("name", (F.size("g") == F.size("e")).alias("same_count"), F.size("e").alias("expected")).join(similar, "name", "left").fillna(0, ["similar"])
