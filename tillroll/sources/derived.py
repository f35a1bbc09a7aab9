"""Receipt tables derived from the driver's tables by fixed rules; the same rules in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-08-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """S-01: a table scan; columns and filters reach the Parquet reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = (
        F.when(k % 37 == 0, "REJECTED").when(k % 29 == 0, "DEAD")
        .when(F.col("o_orderstatus") == "O", "AWARDED").when(F.col("o_orderstatus") == "F", "FAILED").otherwise("PENDING")
    )
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), F.concat(F.lit("t"), c % 3).alias("tenant_id"), c.alias("member_id"), F.col("o_totalprice").alias("total_amount"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"), F.col("o_orderdate").alias("created_at"), F.to_date("o_orderdate").alias("receipt_date"),
        status.alias("status"), ((k * 7919) % 86400).cast("int").alias("receipt_time_s"), F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lpad(k.cast("string"), 9, "0"))).alias("reference_codes"),
        (k % 6).cast("int").alias("send_attempts"), F.when(k % 5 != 0, F.concat(F.lit("m"), c % 4)).alias("merchant_code"), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("img"), k)).alias("source_image_id"),
    )


RECEIPTS_SQL = """receipts AS (
  SELECT o_orderkey AS id, 't' || (o_custkey % 3) AS tenant_id, o_custkey AS member_id, o_totalprice AS total_amount,
    CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderdate AS created_at, CAST(o_orderdate AS DATE) AS receipt_date,
    CASE WHEN o_orderkey % 37 = 0 THEN 'REJECTED' WHEN o_orderkey % 29 = 0 THEN 'DEAD' WHEN o_orderstatus = 'O' THEN 'AWARDED'
      WHEN o_orderstatus = 'F' THEN 'FAILED' ELSE 'PENDING' END AS status,
    CAST((o_orderkey * 7919) % 86400 AS INTEGER) AS receipt_time_s,
    CASE WHEN o_orderkey % 4 = 0 THEN CAST([] AS VARCHAR[]) ELSE [lpad(CAST(o_orderkey AS VARCHAR), 9, '0')] END AS reference_codes,
    CAST(o_orderkey % 6 AS INTEGER) AS send_attempts, CASE WHEN o_orderkey % 5 <> 0 THEN 'm' || (o_custkey % 4) END AS merchant_code,
    CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'img' || o_orderkey END AS source_image_id
  FROM orders)"""


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second photos (8 s later, every other one without its reference) and repeat purchases (38 min later)."""
    base = receipts(spark, sf_dir).filter("status <> 'REJECTED'")
    photo = base.filter("id % 10 = 0").withColumns({
        "reference_codes": F.when(F.col("id") % 20 == 0, F.array().cast("array<string>")).otherwise(F.col("reference_codes")),
        "id": F.col("id") + 1_000_000_000, "receipt_time_s": F.col("receipt_time_s") + 8,
    })
    again = base.filter("id % 10 = 1").withColumns({"reference_codes": F.array().cast("array<string>"), "id": F.col("id") + 2_000_000_000, "receipt_time_s": F.col("receipt_time_s") + 38 * 60})
    return photo.unionByName(again)


INCOMING_SQL = """incoming AS (
  SELECT * REPLACE (id + 1000000000 AS id, receipt_time_s + 8 AS receipt_time_s,
    CASE WHEN id % 20 = 0 THEN CAST([] AS VARCHAR[]) ELSE reference_codes END AS reference_codes) FROM receipts WHERE status <> 'REJECTED' AND id % 10 = 0
  UNION ALL
  SELECT * REPLACE (id + 2000000000 AS id, receipt_time_s + 2280 AS receipt_time_s, CAST([] AS VARCHAR[]) AS reference_codes)
  FROM receipts WHERE status <> 'REJECTED' AND id % 10 = 1)"""


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One for each region; not all of them have receipts."""
    return table(spark, sf_dir, "region").select(F.concat(F.lit("t"), "r_regionkey").alias("tenant_id"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), F.concat(F.lit("t"), k % 3).alias("tenant_id"), F.concat(F.lit("line"), k).alias("line_user_id"),
        F.when(k % 11 != 0, F.concat(F.lit("crm"), k)).alias("crm_customer_id"), (k % 13 != 0).alias("phone_verified"),
        F.concat(F.element_at(F.array(*map(F.lit, ("+668", "09", "(06", "02", "66 8"))), (k % 5 + 1).cast("int")), F.lpad((k * 7).cast("string"), 8, "0"), F.when(k % 5 == 2, ")").otherwise("")).alias("phone"),
    )


MEMBERS_SQL = """members AS (
  SELECT c_custkey AS id, 't' || (c_custkey % 3) AS tenant_id, 'line' || c_custkey AS line_user_id,
    CASE WHEN c_custkey % 11 <> 0 THEN 'crm' || c_custkey END AS crm_customer_id, c_custkey % 13 <> 0 AS phone_verified,
    ['+668', '09', '(06', '02', '66 8'][c_custkey % 5 + 1] || lpad(CAST(c_custkey * 7 AS VARCHAR), 8, '0') || CASE WHEN c_custkey % 5 = 2 THEN ')' ELSE '' END AS phone
  FROM customer)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed requests in time: (event_id, key, ts, event_type, value)."""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), "ts", "event_type", "value")


def files(path: str, spark: SparkSession, suffixes: tuple[str, ...] = (".jpg", ".jpeg", ".png")) -> DataFrame:
    """S-04, S-10, S-11: stored images with their trailing number, ordered by it; prepared copies are left out."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)
    kept = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).isin(*suffixes) & ~stem.contains("__prepared")
    number = F.expr("try_cast(regexp_extract(element_at(split(element_at(split(path, '/'), -1), '_'), -1), '([0-9]+)', 1) AS bigint)")
    return read.withColumns({"name": name, "number": number}).filter(kept).orderBy("number", "name")


def ocr_texts(spark: SparkSession, path: str) -> DataFrame:
    """S-05: one row per stored text with its lines."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.split("value", "\n").alias("lines"))


def truth(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """S-08: the ground truth, an object of records by file name, as rows."""
    record = "struct<expected_total:double,purchase_id:string,document_id:string,doc_type:string,merchant_brand:string,merchant_text:string,date:string,time:string,reference_codes:array<string>,items:array<struct<name:string,price:double>>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{record}>").alias("m"))
    rows = raw.select(F.explode("m").alias("name", "t")).select("name", "t.*")
    return rows.filter(F.col("name").isin(names)) if names else rows


JOB = "job_id string, tenant_id string, member_id bigint, receipt_id string, image_key string"


def parse_jobs(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S-14, S-17: queue messages as (jobs, bad messages); works on batches and streams alike."""
    parsed = messages.select("value", F.from_json("value", JOB).alias("job"))
    sound = F.col("job").isNotNull() & F.col("job.job_id").isNotNull()
    return parsed.filter(sound).select("job.*"), parsed.filter(~sound).select("value")
