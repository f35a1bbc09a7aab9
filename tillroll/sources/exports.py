"""Tables as CSV files in one order over many files, and the sheets that people get.

An export is sorted by range: each task writes the next numbered part, all with the same header, and a manifest names the parts in order
with their rows.  No task sees more than its part.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.operators.ledger import money
from tillroll.sources.scratch import kept
from tillroll.sources.store import opened

UNSENT = ("FAILED", "PENDING", "DEAD")
MANIFEST = "_parts.json"


def unsent_sheet(receipts: DataFrame, members: DataFrame, formula: str) -> DataFrame:
    """S-12: what has to be awarded by hand, oldest first within a tenant: tenant_id, created_at and id for the order, and the sheet's seven columns."""
    owners = members.select(F.col("id").alias("member_id"), "crm_customer_id")
    text = lambda c: F.coalesce(c, F.lit(""))
    return receipts.filter(F.col("status").isin(*UNSENT)).join(owners, "member_id").select(
        "tenant_id", "created_at", "id", text(F.col("crm_reference")).alias("crm_reference"), text(F.col("crm_customer_id")).alias("customer_id"), money(F.col("cents")).alias("amount"),
        F.lit(formula).alias("formula_id"), text(F.col("merchant")).alias("merchant"), text(F.date_format("receipt_date", "yyyy-MM-dd")).alias("receipt_date"), "status",
    )


def item_text(items: Column) -> Column:
    """F-40: ``name = price`` of each item, the price without decimals (halves to even), the name alone without a price."""
    one = lambda x: F.when(x["price"].isNull(), x["name"]).otherwise(F.concat(x["name"], F.lit(" = "), F.bround(x["price"], 0).cast("bigint").cast("string")))
    return F.array_join(F.transform(items, one), "; ")


def extraction_report(records: DataFrame) -> DataFrame:
    """S-13, F-40: a line of eleven columns for each record of :func:`tillroll.operators.extract.extract_receipts` with its ``filename``.

    Rejected records have a cross, a reason and empty fields; their lines stay readable.
    """
    ok = ~F.col("rejected")
    shown = lambda c: F.when(ok, F.coalesce(c, F.lit(""))).otherwise("")
    clock = F.format_string("%02d:%02d", F.floor(F.col("receipt_time_s") / 3600), F.floor(F.col("receipt_time_s") % 3600 / 60))
    return records.select(
        "filename", F.when(ok, "✓").otherwise("✗").alias("ok"), shown(F.col("merchant")).alias("merchant"), shown(F.col("merchant_code")).alias("merchant_code"),
        F.when(ok, F.col("total_amount")).alias("total_amount"), shown(F.date_format("receipt_date", "yyyy-MM-dd")).alias("receipt_date"),
        shown(F.when(F.col("receipt_time_s").isNotNull(), clock)).alias("receipt_time"), shown(F.array_join("reference_codes", ", ")).alias("reference_codes"),
        shown(item_text(F.col("items"))).alias("items"), F.when(ok, "").otherwise("no total").alias("reason"), F.array_join("lines", "\n").alias("raw_text"),
    )


def write_csv(df: DataFrame, path: str, order: list[Column], columns: list[str] | None = None, parts_at_most: int | None = None) -> list[dict]:
    """Writes ``columns`` of ``df`` in ``order`` below ``path``, and the manifest behind all parts.  Returns the manifest: name and rows of each part."""
    ranged = df.repartitionByRange(*([parts_at_most] if parts_at_most else []), *order).sortWithinPartitions(*order)
    # the order is fixed by a table before it is counted and written, as two runs of a sort may cut ranges differently
    held = kept(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()), "export")
    counts = sorted(held.groupBy("_part").count().collect())
    parts = {old: new for new, (old, _) in enumerate(counts)}
    number = F.element_at(F.create_map(*(F.lit(x) for pair in parts.items() for x in pair)), F.col("_part")) if parts else F.lit(0)
    chosen = columns or df.columns
    rows = held.withColumn("part", F.format_string("%06d", number)).repartition(max(len(parts), 1), "part").sortWithinPartitions("part", "_place")
    rows.select("part", *chosen).write.partitionBy("part").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    manifest = [{"part": f"{parts[old]:06d}", "rows": n} for old, n in counts]
    files, root = opened(path)
    with files.open_output_stream(f"{root}/{MANIFEST}") as stream:
        stream.write(json.dumps({"columns": chosen, "parts": manifest}).encode())
    return manifest


def read_in_order(path: str) -> Iterator[bytes]:
    """One CSV text, piece by piece: the header and then all parts in order.  A part that the manifest doesn't name isn't read."""
    from pyarrow import fs

    files, root = opened(path)
    with files.open_input_stream(f"{root}/{MANIFEST}") as stream:
        manifest = json.loads(stream.read())
    yield (",".join(manifest["columns"]) + "\n").encode()
    for part in manifest["parts"]:
        for info in sorted(files.get_file_info(fs.FileSelector(f"{root}/part={part['part']}")), key=lambda x: x.path):
            if info.base_name.startswith("part-"):
                with files.open_input_stream(info.path) as stream:
                    rest, first = b"", True
                    while block := stream.read(1 << 20):
                        rest += block
                        if first:
                            if b"\n" not in rest:
                                continue
                            rest, first = rest.partition(b"\n")[2], False
                        yield rest
                        rest = b""
