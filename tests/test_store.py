"""Files by key, uploads, the cache of lines, exports in order and the depth of a queue."""

import csv
import datetime as dt
import io
import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tillroll.sources import exports, store
from tillroll.streaming import jobs

PNG = b"\x89PNG\r\n\x1a\n"


def test_keys_stay_below_their_folder(spark):
    base = tempfile.mkdtemp()
    good = {"a.txt": "a.txt", "x/./y//z": "x/y/z", "x/../b": "b", "..a": "..a"}
    bad = ["", None, ".", "..", "../a", "x/../../a", "/etc/a", "a\0b", "a\\..\\b", "_manifest/x", "x/.."]
    rows = spark.createDataFrame([(k, f"{k}!".encode()) for k in [*good, *bad]], "key string, content binary")
    kept, rejected = store.store_files(rows, base)
    assert {r.key: r.bytes for r in kept.collect()} == {v: len(f"{k}!".encode()) for k, v in good.items()}
    assert sorted(map(str, (r.key for r in rejected.collect()))) == sorted(map(str, bad))
    assert not os.path.exists(f"{os.path.dirname(base)}/a") and sorted(f for _, _, names in os.walk(base) for f in names if f in ("a.txt", "z", "b", "..a")) == ["..a", "a.txt", "b", "z"]
    assert not [f for _, _, names in os.walk(base) for f in names if f.endswith(".part")]


def test_texts_round_trip_and_last_write(spark):
    base = "file://" + tempfile.mkdtemp()
    assert store.read_texts(spark, base).count() == 0
    texts = {("t1", "r1"): ["one", "สอง", ""], ("t1", "r2"): ["x"], ("t2", "r1"): [""], ("../..", "r"): ["out"]}
    rows = spark.createDataFrame([(*k, v) for k, v in texts.items()], "tenant_id string, receipt_id string, lines array<string>").repartition(3)
    _, rejected = store.store_texts(rows, base)
    assert [r.key for r in rejected.collect()] == ["receipts/../../r.txt"]
    want = {f"receipts/{t}/{r}.txt": v for (t, r), v in texts.items() if t != "../.."}
    assert {r.key: r.lines for r in store.read_texts(spark, base).collect()} == want
    store.store_texts(spark.createDataFrame([("t1", "r2", ["new", "lines"])], rows.schema), base)
    assert {r.key: r.lines for r in store.read_texts(spark, base).collect()} == want | {"receipts/t1/r2.txt": ["new", "lines"]}
    # a file that no manifest names isn't there; one that changed behind its back is an error
    with open(f"{base[7:]}/receipts/t1/left.txt", "w") as file, open(f"{base[7:]}/receipts/t1/r1.txt", "w") as other:
        file.write("half")
        other.write("x")
    assert {r.key: r.error for r in store.read_stored(spark, base).collect() if "t1" in r.key} == {"receipts/t1/r1.txt": "changed", "receipts/t1/r2.txt": None}


def test_uploads_keep_going(spark):
    folder = tempfile.mkdtemp()
    files = {"a.png": PNG + b"1", "b.jpg": b"\xff\xd8\xff2", "text.png": b"no image", "empty.png": b"", "long.png": PNG + b"x" * 100, "other.png": PNG}
    for name, data in files.items():
        with open(f"{folder}/{name}", "wb") as file:
            file.write(data)
    os.mkdir(f"{folder}/dir.png")
    names = ["b.jpg", "a.png", "text.png", "gone.png", "empty.png", "long.png", "dir.png", "../a.png", "a.png"]
    rows = store.upload_batch(spark, folder, names, most_bytes=50).orderBy("place").collect()
    assert [r.filename for r in rows] == names
    assert [r.ok for r in rows] == [True, True, False, False, False, False, False, False, True]
    assert [r.reason for r in rows][2:6] == ["no image", "missing", "no image", "too long"] and rows[6].reason and rows[7].reason
    assert bytes(rows[0].content) == files["b.jpg"] and rows[5].content is None
    for wrong in ([], ["x"] * 31):
        with pytest.raises(ValueError):
            store.upload_batch(spark, folder, wrong)


def test_lines_are_cached_by_name_and_time(spark):
    folder, cache, log = tempfile.mkdtemp(), tempfile.mkdtemp() + "/cache", tempfile.mkdtemp()

    def put(name, text, second):
        with open(f"{folder}/{name}", "w") as file:
            file.write(text)
        os.utime(file.name, (second, second))

    def read(rows):
        """Lines of the content; each file that is read leaves a mark."""

        def one(name, content):
            with open(f"{log}/{name}-{random.random()}", "w"):
                pass
            return content.decode().split()

        return rows.select("name", "stamp", F.udf(one, "array<string>")("name", "content").alias("lines"))

    def run(**options):
        before = set(os.listdir(log))
        rows = {r.name: r["lines"] for r in store.cached_lines(store.listing(spark, folder), read, cache, **options).collect()}
        return rows, sorted(x.split("-")[0] for x in set(os.listdir(log)) - before)

    put("a", "1 2", 1000)
    put("b", "3", 1000)
    assert run() == ({"a": ["1", "2"], "b": ["3"]}, ["a", "b"])
    assert run() == ({"a": ["1", "2"], "b": ["3"]}, [])
    put("b", "4", 2000)
    put("c", "5", 1000)
    assert run() == ({"a": ["1", "2"], "b": ["4"], "c": ["5"]}, ["b", "c"])
    os.remove(f"{folder}/a")
    put("b", "3", 1000)  # the old stamp again: its old lines are right
    assert run() == ({"b": ["3"], "c": ["5"]}, [])
    assert run(fresh=True) == ({"b": ["3"], "c": ["5"]}, ["b", "c"])
    # an increment that was never named doesn't count
    os.makedirs(f"{cache}/half")
    with open(f"{cache}/half/part-0.parquet", "w") as file:
        file.write("broken")
    assert run()[1] == []


def test_exports_are_in_order(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["A", "B"]), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r.randint(0, 500)), r.choice(['say "x", y', "", None, "two\nlines", "ü"])) for i in range(2000)]
    df = spark.createDataFrame(rows, "id bigint, tenant string, at timestamp, note string").repartition(5)
    path = tempfile.mkdtemp() + "/out"
    manifest = exports.write_csv(df, path, [F.col("tenant"), F.col("at"), F.col("id")], ["id", "tenant", "note"], parts_at_most=7)
    assert len(manifest) > 1 and sum(p["rows"] for p in manifest) == 2000 and [p["part"] for p in manifest] == sorted(p["part"] for p in manifest)
    text = b"".join(exports.read_in_order(path)).decode()
    got = list(csv.reader(io.StringIO(text)))
    assert got[0] == ["id", "tenant", "note"]
    assert [(int(i), t, n) for i, t, n in got[1:]] == [(i, t, n or "") for i, t, _, n in sorted(rows, key=lambda x: (x[1], x[2], x[0]))]
    empty = tempfile.mkdtemp() + "/out"
    assert exports.write_csv(df.limit(0), empty, [F.col("id")]) == [] and b"".join(exports.read_in_order(empty)) == b"id,tenant,at,note\n"


def test_item_texts(spark):
    items = [[("tea", 12.5), ("rice", 13.5), ("free", None)], [], None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, items array<struct<name:string,price:double>>")
    assert [r[0] for r in df.orderBy("i").select(exports.item_text(F.col("items"))).collect()] == ["tea = 12; rice = 14; free", "", None]


def test_queue_depth(spark):
    folder, at = tempfile.mkdtemp(), tempfile.mkdtemp()

    def put(name, n):
        with open(f"{folder}/{name}", "w") as file:
            file.writelines(json.dumps({"job_id": f"{name}-{i}"}) + "\n" for i in range(n))

    def run(fail=False):
        def work(batch, number):
            if fail:
                raise RuntimeError("worker is down")
            batch.count()

        source = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(folder)
        query = source.writeStream.foreachBatch(work).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        try:
            query.awaitTermination(120)
        except Exception:
            assert fail

    depth = lambda: jobs.queue_depth(spark, folder, f"{at}/state")
    put("a b.txt", 3)
    put("c.txt", 4)
    assert depth() == 7
    run(fail=True)
    assert depth() == 7
    run()
    assert depth() == 0
    put("d.txt", 5)
    assert depth() == 5
    run()
    assert depth() == 0
