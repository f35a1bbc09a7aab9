"""Streams read from files, batch by batch, and the sources of files and messages."""

import json
import tempfile

from pyspark.sql import functions as F

from tillroll.functions import privacy
from tillroll.operators.dedup import image_fingerprint
from tillroll.sources import derived
from tillroll.streaming import jobs

EVENT = "event_id bigint, key bigint, ts timestamp, event_type string"


def streamed(spark, batches, build, mode):
    """All rows that a stream emits when it reads ``batches`` one after the other."""
    folder, out = tempfile.mkdtemp(), []
    for i, rows in enumerate(batches):
        with open(f"{folder}/{i}.json", "w") as file:
            file.writelines(json.dumps(dict(zip(["event_id", "key", "ts", "event_type"], row))) + "\n" for row in rows)
        source = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(folder)
        query = build(source).writeStream.outputMode(mode).foreachBatch(lambda df, n: out.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{folder}/_state").trigger(availableNow=True).start()
        query.awaitTermination(120)
    return out


def test_job_status_stream_forgets(spark):
    batches = [[(1, 1, "2024-01-01T00:00:00", "queued"), (2, 1, "2024-01-01T00:00:05", "running")], [(3, 1, "2024-01-01T00:00:01", "late")], [(4, 2, "2024-01-01T05:00:00", "queued")], [(5, 2, "2024-01-01T05:00:01", "done")]]
    got = [(k, s) for k, s, _ in streamed(spark, batches, lambda s: jobs.job_status_stream(s), "update")]
    assert got[0] == (1, "running") and (1, "late") not in got and got.count((1, None)) == 1 and got[-1] == (2, "done")


def test_jobs_to_tables(spark):
    folder = tempfile.mkdtemp()
    good = {"job_id": "j1", "tenant_id": "t", "member_id": 3, "receipt_id": "r", "image_key": "k"}
    with open(f"{folder}/m.txt", "w") as file:
        file.write(json.dumps(good) + "\nnot json\n{\"tenant_id\": \"t\"}\n")
    source = spark.readStream.schema("value string").text(folder, pathGlobFilter="*.txt")
    jobs.jobs_to_tables(source, f"{folder}/jobs", f"{folder}/bad", f"{folder}/_state").trigger(availableNow=True).start().awaitTermination(120)
    assert [r.member_id for r in spark.read.parquet(f"{folder}/jobs").collect()] == [3]
    assert sorted(r.value for r in spark.read.parquet(f"{folder}/bad").collect()) == ["not json", '{"tenant_id": "t"}']


def test_files_texts_and_truth(spark):
    folder = tempfile.mkdtemp()
    for name, data in (("a_10.jpg", b"\xff\xd8\xff1"), ("a_9.PNG", b"\x89PNG\r\n\x1a\n"), ("a_1__prepared.jpg", b"x"), ("a_2.txt", b"one\ntwo")):
        with open(f"{folder}/{name}", "wb") as file:
            file.write(data)
    found = derived.files(folder, spark).select("name", "number", privacy.is_image(F.col("content")), image_fingerprint(F.lit("t"), F.col("content"))).collect()
    assert [(r[0], r[1], r[2]) for r in found] == [("a_9.PNG", 9, True), ("a_10.jpg", 10, True)] and len({r[3] for r in found}) == 2
    assert [tuple(r) for r in derived.ocr_texts(spark, f"{folder}/a_2.txt").collect()] == [("a_2.txt", ["one", "two"])]
    with open(f"{folder}/truth.json", "w") as file:
        json.dump({"a_9.PNG": {"expected_total": 5.5, "items": [{"name": "tea", "price": 5.5}]}, "b": {}}, file)
    assert [(r.name, r.expected_total, r["items"][0].name) for r in derived.truth(spark, f"{folder}/truth.json", ["a_9.PNG"]).collect()] == [("a_9.PNG", 5.5, "tea")]
