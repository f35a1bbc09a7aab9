"""Queries over the receipt ledger: status metrics, dead letters, exports, resends, retention, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.sources.scratch import kept

STATUSES = ("PENDING", "AWARDED", "FAILED", "DEAD", "REJECTED")
SEND_LIMIT = 5


def status_metrics(receipts: DataFrame, tenants: DataFrame, *, as_of: str | None = None, since_days: int | None = None) -> DataFrame:
    """A-01 to A-04, P-04: counts by status in one pass; a window of N days reaches back to midnight N days ago.

    Each of ``tenants`` (tenant_id) has a row, with zeros if it has no receipts; receipts of other tenants, and those without one,
    are counted under their own.
    """
    if since_days is not None:
        receipts = receipts.filter(F.col("created_at") >= F.date_sub(F.lit(as_of).cast("date"), since_days).cast("timestamp"))
    counts = receipts.groupBy("tenant_id").agg(*(F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES))
    counts = _each_tenant(tenants, counts, [s.lower() for s in STATUSES])
    eligible = sum((F.col(c) for c in ("awarded", "pending", "failed")), F.col("dead"))
    return counts.withColumns({
        "total": sum((F.col(s.lower()) for s in STATUSES[1:]), F.col("pending")),
        "award_rate": F.coalesce(F.round(F.col("awarded") / F.nullif(eligible, F.lit(0)), 3), F.lit(0.0)),
        "needs_attention": F.col("dead") > 0,
    })


def _each_tenant(tenants: DataFrame, counts: DataFrame, columns: list[str]) -> DataFrame:
    """``counts`` with a row of zeros for each of ``tenants`` that has none."""
    zeros = tenants.select("tenant_id", *(F.lit(0).cast("bigint").alias(c) for c in columns))
    return counts.select("tenant_id", *columns).unionByName(zeros).groupBy("tenant_id").agg(*(F.sum(c).alias(c) for c in columns))


def dead_letters(receipts: DataFrame, tenant: str, limit: int = 100) -> DataFrame:
    """O-03: the oldest DEAD rows of a tenant."""
    return receipts.filter((F.col("tenant_id") == tenant) & (F.col("status") == "DEAD")).orderBy("created_at", "id").limit(limit)


def status_count(receipts: DataFrame, tenants: DataFrame, status: str) -> DataFrame:
    """A-05: rows of one status for each tenant, whatever the lists' limits are; tenants without receipts have 0."""
    return _each_tenant(tenants, receipts.groupBy("tenant_id").agg(F.count_if(F.col("status") == status).alias("n")), ["n"])


def unsent(receipts: DataFrame, members: DataFrame) -> DataFrame:
    """J-01, O-05, S-12: unsent points with their members, oldest first; orphans drop out."""
    rows = receipts.filter(F.col("status").isin("FAILED", "PENDING", "DEAD"))
    owners = members.select(F.col("id").alias("member_id"), "phone", F.coalesce("crm_customer_id", F.lit("")).alias("crm_customer_id"))
    return rows.join(owners, "member_id").select(
        "id", "created_at", "phone", "crm_customer_id", money(F.col("cents")).alias("amount"), "status", F.coalesce("merchant_code", F.lit("")).alias("merchant_code")
    )


def money(cents: Column) -> Column:
    """Two decimals from whole cents, so that no binary rounding occurs."""
    whole = F.abs(cents)
    return F.concat(F.when(cents < 0, "-").otherwise(""), F.floor(whole / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((whole % 100).cast("string"), 2, "0"))


def history(receipts: DataFrame, limit: int = 20) -> DataFrame:
    """O-04 for all members: the newest AWARDED receipts of each."""
    newest = Window.partitionBy("member_id").orderBy(F.desc("created_at"), F.desc("id"))
    return receipts.filter("status = 'AWARDED'").withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= limit)


def resend_batch(receipts: DataFrame, members: DataFrame, outcomes: DataFrame, limit: int = 50) -> DataFrame:
    """T-08, O-02, J-03, W-01: what a round of resends does to the oldest FAILED rows.

    ``outcomes`` (id, outcome) tells what the service answers: ok, retryable or rejected.  Rows of
    members without a CRM id are skipped.  The round stops behind the first retryable failure.  The
    window runs over ``limit`` rows at most.
    """
    batch = receipts.filter("status = 'FAILED'").orderBy("created_at", "id").limit(limit)
    owners = members.select(F.col("id").alias("member_id"), "crm_customer_id")
    rows = batch.join(owners, "member_id", "left").join(outcomes, "id", "left")
    tried = F.coalesce(F.col("crm_customer_id"), F.lit("")) != ""
    rows = rows.withColumn("result", F.when(tried, F.coalesce("outcome", F.lit("ok"))).otherwise("skipped"))
    before = Window.orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.sum((F.col("result") == "retryable").cast("int")).over(before), F.lit(0)) > 0
    result = F.when(stopped, "not_reached").otherwise(F.col("result"))
    attempts = F.col("send_attempts") + (result == "rejected").cast("int")
    status = F.when(result == "ok", "AWARDED").when((result == "rejected") & (attempts >= SEND_LIMIT), "DEAD").otherwise("FAILED")
    return rows.select("id", result.alias("result"), attempts.alias("send_attempts"), status.alias("status"), F.when(result == "ok", F.concat(F.lit("gp"), "id")).alias("crm_reference"))


def batch_summary(resent: DataFrame) -> DataFrame:
    """A-15, Q15: ``attempted`` counts all fetched rows, also skipped ones."""
    return resent.agg(
        F.count("*").alias("attempted"), F.count_if(F.col("status") == "AWARDED").alias("succeeded"),
        F.count_if(F.col("status") == "FAILED").alias("remaining"), F.count_if(F.col("status") == "DEAD").alias("dead"),
    )


def revive(receipts: DataFrame, ids: DataFrame) -> DataFrame:
    """T-09: the next version of asked-for rows; only DEAD ones change.  ``ids`` (id)."""
    rows = ids.join(receipts, "id", "left")
    dead = F.coalesce(F.col("status") == "DEAD", F.lit(False))
    return rows.select("id", dead.alias("revived"), F.when(dead, "FAILED").otherwise(F.col("status")).alias("status"), F.when(dead, 0).otherwise(F.col("send_attempts")).alias("send_attempts"))


def purge_plan(receipts: DataFrame, as_of: str, keep_days: int = 90, limit: int = 500) -> DataFrame:
    """T-10, P-05, O-06, Q5: rows whose image and text are due; a second run after :func:`purged` finds none."""
    due = F.col("created_at") < F.date_sub(F.lit(as_of).cast("date"), keep_days).cast("timestamp")
    rows = receipts.filter(due & (F.col("source_image_id") != "")).orderBy("id").limit(limit)
    return rows.select("id", F.concat("source_image_id", F.lit(".jpg")).alias("image_key"), F.concat("source_image_id", F.lit(".txt")).alias("text_key"))


def purged(receipts: DataFrame, plan: DataFrame) -> DataFrame:
    """The ledger after a purge: images are marked as gone, rows stay."""
    gone = plan.select("id", F.lit(True).alias("gone"))
    return receipts.join(gone, "id", "left").withColumn("source_image_id", F.when(F.col("gone"), "").otherwise(F.col("source_image_id"))).drop("gone")


def eligible_members(members: DataFrame) -> DataFrame:
    """P-06, P-07: who may scan, and whom the worker would serve."""
    linked = F.coalesce(F.col("crm_customer_id"), F.lit("")) != ""
    return members.select("id", (linked & F.col("phone_verified")).alias("may_scan"), linked.alias("may_receive"))


def get_or_create(members: DataFrame, asked: DataFrame) -> DataFrame:
    """S-03, J-10: members by (tenant_id, line_user_id); those asked for and unknown are added with new ids.

    New ids go on behind the greatest one without gaps, in the order of tenant and user, so a second run gives the
    same ones.  New rows are sorted by range into a table; the counts of its parts (one number a part goes to the driver) say where each
    part's numbers begin, so no task sees more than its part.  Asked rows without a user are no members and drop out; a null tenant is one like others.
    """
    keys = ["tenant_id", "line_user_id"]
    wanted = asked.select(*keys).filter("line_user_id IS NOT NULL").distinct()
    same = [F.col(f"w.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    known = members.alias("m").join(wanted.alias("w"), same, "left_semi").select("id", *keys)
    new = wanted.alias("w").join(members.select(*keys).alias("m"), same, "left_anti")
    top = members.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first().top
    made = numbered(new, keys, top + 1).select("id", *keys, F.lit(True).alias("created"))
    return known.withColumn("created", F.lit(False)).unionByName(made)


def numbered(rows: DataFrame, order: list[str], first: int) -> DataFrame:
    """``rows`` with a column ``id`` from ``first`` on, without gaps, in ``order`` (nulls first)."""
    by = [F.asc_nulls_first(c) for c in order]
    held = kept(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    begins, total = {}, first
    for part, n in sorted(held.groupBy("part").count().collect()):
        begins[part] = total
        total += n
    begin = F.element_at(F.create_map(*(F.lit(x) for pair in begins.items() for x in pair)), F.col("part")) if begins else F.lit(first)
    return held.select((begin + F.col("place")).cast("bigint").alias("id"), *rows.columns)


def stuck_pending(receipts: DataFrame, as_of: str, days: int = 1) -> DataFrame:
    """Extension (Q13): PENDING rows that no resend will pick up."""
    return receipts.filter((F.col("status") == "PENDING") & (F.col("created_at") < F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp")))
