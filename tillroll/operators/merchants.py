"""F-19, F-20, J-05, J-06: the merchant of a receipt by a registry table.

A registry has code, name, tax_id, keywords (array) and priority.  A receipt that shows a tax id of the registry belongs to
the first merchant (by priority, then code) of which it shows one; otherwise to the first whose keyword its text holds: in lower case, with
look-alike digits read as letters, or nearly.  Null or empty tax ids and keywords match nothing; a null priority comes last; a
null code is no merchant.  Keywords are compared in lower case.  Rows without lines have no merchant.

Rows are dealt by their lines and sorted within tasks, so that equal lines follow each other and are compared once; a hot text is split over
tasks by its rows.  The registry goes to all tasks in blocks of ``block`` rows at most; one of more rows takes a pass over the distinct lines for
each block, and only one block is held by the driver at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tillroll.functions.lookup import keywords
from tillroll.sources.scratch import kept

BLOCK = 50_000
LEAST = 0.80
FOUND = "struct<tier:int,rank:bigint,code:string,name:string>"
_GAP, _TAX, _LAST = re.compile(r"[\s\-]"), re.compile("[0-9]{13}"), (1 << 63) - 1
# fixed values: digits that are read as letters
_LOOK = str.maketrans("0158", "oisb")


def finder(rows: list[Row], least: float | None = LEAST):
    """A column function of lines: the first merchant of ``rows`` as (tier, rank, code, name); tier 0 is a tax id, 1 a keyword."""
    known = [r for r in rows if r.code is not None]
    ranked = sorted(((_LAST if r.priority is None else r.priority, r.code, r.name, r.tax_id, r.keywords or ()) for r in known), key=lambda x: (x[0], x[1], x[2] or ""))
    by_tax: dict[str, int] = {}
    by_word: dict[str, int] = {}
    for i, (_, _, _, tax, words) in enumerate(ranked):
        if tax:
            by_tax.setdefault(tax, i)
        for word in words:
            if word:
                by_word.setdefault(word.lower(), i)
    names = [(rank, code, name) for rank, code, name, _, _ in ranked]
    words, owners = tuple(by_word), list(by_word.values())

    @F.pandas_udf(FOUND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = keywords(words, least)
        for batch in batches:
            texts: list[str] = []
            open_rows: list[int] = []
            number: dict[tuple, int] = {}  # of each different row, in the order of their first occurrence
            place = [-1 if lines is None else number.setdefault(tuple(lines), len(number)) for lines in batch]
            best: list[tuple[int, int] | None] = [None] * (len(number) + 1)  # the last one is that of no lines
            for i, lines in enumerate(number):
                lines = [s for s in lines if s is not None]
                ids = [by_tax[t] for s in lines for t in _TAX.findall(_GAP.sub("", s)) if t in by_tax]
                if ids:
                    best[i] = (0, min(ids))
                    continue
                text = " ".join(lines).lower()
                folded = text.translate(_LOOK)
                hits = index.exact(text) | index.exact(folded)
                if hits:
                    best[i] = (1, min(owners[h] for h in hits))
                if not hits or best[i][1]:  # the very first merchant can't be beaten
                    texts.append(folded)
                    open_rows.append(i)
            if least is not None:
                for i, near in zip(open_rows, index.near(texts), strict=True):
                    if near:
                        best[i] = min(best[i] or (2, 0), (1, min(owners[k] for k in near)))
            made = [(None,) * 4 if b is None else (b[0], *names[b[1]]) for b in best]
            columns = {c: [made[i][k] for i in place] for k, c in enumerate(("tier", "rank", "code", "name"))}
            yield pd.DataFrame({c: pd.array(v, kind) for (c, v), kind in zip(columns.items(), ("Int32", "Int64", "string", "string"), strict=True)})

    return run


def identify_by(df: DataFrame, registry: DataFrame, least: float | None = LEAST, block: int = BLOCK) -> DataFrame:
    """``df`` with merchant_code and merchant from its ``lines`` and, where it has one, its merchant_text.

    ``least`` is the similarity of near keywords; with None only exact ones count.
    """
    registry = registry.select("code", "name", "tax_id", "keywords", F.col("priority").cast("bigint").alias("priority"))
    size = registry.count()
    blocks = 1 if size <= block else -(-2 * size // block)  # blocks by hash of about half that size
    held = "_" * (max(map(len, df.columns)) + 1)
    at = held + "at"
    df = df.withColumn(at, F.xxhash64("lines")).hint("rebalance", at).sortWithinPartitions(at)

    def passed(texts: DataFrame, k: int) -> DataFrame:
        rows = registry.filter(F.pmod(F.xxhash64("code"), F.lit(blocks)) == k).collect()
        found = finder(rows, least)(F.col("lines"))
        return texts.withColumn(held, F.least(held, F.when(found["code"].isNotNull(), found)))

    if blocks == 1:
        df = passed(df.withColumn(held, F.lit(None).cast(FOUND)), 0)
    else:
        df = kept(df, "merchants")
        tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
        texts = df.filter("lines IS NOT NULL").select("lines").distinct().repartition(tasks).withColumn(held, F.lit(None).cast(FOUND))
        for k in range(blocks):
            texts = passed(texts, k)
            if k + 1 < blocks:
                texts = kept(texts, "merchants")
        df = df.join(texts, "lines", "left").select(*df.columns, held)
    df = df.drop(at)
    text = [F.col("merchant_text")] if "merchant_text" in df.columns else []
    out = df.withColumns({"merchant_code": F.col(held)["code"], "merchant": F.coalesce(F.col(held)["name"], *text, F.lit("unknown"))})
    return out.drop(held)
