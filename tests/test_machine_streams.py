"""Streams of claims, codes and breakers over several micro-batches, with expiry, restarts and a start from a table."""

import json
import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from tillroll.operators import state
from tillroll.operators.machine import fold, last_links
from tillroll.streaming import machines

SCHEMA = "event_id bigint, key string, ts timestamp, issued timestamp, good boolean, outcome string"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    machines.use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def at(second):
    return f"2024-01-01T{second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}"


class Feed:
    """A folder that a stream reads file by file; each :meth:`send` is a run of its own from the same checkpoint."""

    def __init__(self, spark, build):
        self.spark, self.build, self.folder, self.files, self.out = spark, build, tempfile.mkdtemp(), 0, []

    def send(self, *batches, endless=False):
        before = len(self.out)
        for rows in batches:
            with open(f"{self.folder}/{self.files}.json", "w") as file:
                file.writelines(json.dumps(row) + "\n" for row in rows)
            self.files += 1
            os.utime(file.name, (1_700_000_000 + self.files,) * 2)  # files are read in the order of their times
        source = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(self.folder)
        query = self.build(source).writeStream.outputMode("append").foreachBatch(lambda df, n: self.out.extend(map(tuple, df.collect())))
        query = query.option("checkpointLocation", f"{self.folder}/_state")
        if endless:  # in processing time a stream goes on without data
            running = query.start()
            running.processAllAvailable()
            running.stop()
        else:
            query.trigger(availableNow=True).start().awaitTermination(240)
        return sorted(self.out[before:])


def hit(i, key, second, **more):
    return {"event_id": i, "key": key, "ts": at(second), **more}


def test_rate_limit_and_restart(spark):
    feed = Feed(spark, lambda s: machines.rate_limit_stream(s, limit=2))
    assert feed.send([hit(1, "a", 0), hit(2, "a", 10), hit(3, None, 10)], [hit(4, "a", 20)]) == [(1, "a", 1, True, 0), (2, "a", 2, True, 0), (3, None, 1, True, 0), (4, "a", 3, False, 580)]
    assert feed.send([hit(5, "a", 599), hit(6, "a", 600), hit(7, "a", 601)]) == [(5, "a", 4, False, 1), (6, "a", 1, True, 0), (7, "a", 2, True, 0)]


def test_claims_expire(spark):
    feed = Feed(spark, lambda s: machines.first_claim_stream(s, ttl_s=60, late="5 seconds"))
    assert feed.send([hit(1, "a", 0), hit(2, "a", 30)], [hit(3, "b", 500)], [hit(4, "b", 510)]) == [(1, "a", 1, True), (2, "a", 1, False), (3, "b", 3, True), (4, "b", 3, False)]
    # the watermark has passed the end of key a's claim; a hit behind the watermark is dropped
    assert feed.send([hit(5, "a", 506), hit(6, "a", 100)]) == [(5, "a", 5, True)]


def test_codes(spark):
    feed = Feed(spark, lambda s: machines.otp_attempts_stream(s, limit=2, code_ttl_s=300))
    tries = lambda rows: [hit(i, "a", t, issued=at(i0), good=g) for i, t, i0, g in rows]
    assert feed.send(tries([(1, 1, 0, False)]), tries([(2, 2, 0, False)])) == [(1, "a", "wrong"), (2, "a", "wrong")]
    assert feed.send(tries([(3, 3, 0, True), (4, 4, 0, True)])) == [(3, "a", "locked"), (4, "a", "expired")]
    assert feed.send(tries([(5, 10, 9, True), (6, 11, 9, True), (7, 400, 99, True)])) == [(5, "a", "verified"), (6, "a", "expired"), (7, "a", "expired")]


def calls(*rows):
    return [hit(i, "crm", t, outcome=o) for i, t, o in rows]


def test_breaker_forgets_a_quiet_service(spark):
    feed = Feed(spark, lambda s: machines.circuit_breaker_stream(s, failures=2, open_s=30, forget_s=100, late="1 seconds"))
    got = feed.send(calls((1, 0, "retryable")), calls((2, 5, "retryable"), (3, 34, "ok")))
    assert [(r[0], r[2], r[3]) for r in got] == [(1, True, "closed"), (2, True, "open"), (3, False, "open")]
    got = feed.send(calls((4, 35, "retryable"), (5, 40, "ok")), calls((6, 65, "ok"), (7, 66, "retryable")))
    assert [(r[0], r[2], r[3]) for r in got] == [(4, True, "open"), (5, False, "open"), (6, True, "closed"), (7, True, "closed")]
    # another service moves the watermark; the one failure of this one is forgotten
    feed.send([hit(8, "other", 300, outcome="ok")], [hit(9, "other", 301, outcome="ok")])
    got = feed.send(calls((10, 302, "retryable"), (11, 303, "retryable")))
    assert [(r[0], r[2], r[3]) for r in got] == [(10, True, "closed"), (11, True, "open")]


def test_stream_goes_on_where_a_table_ends(spark):
    machine = state.breaker_machine(3, 30)
    past = spark.createDataFrame([(1, "crm", 0, "retryable"), (2, "crm", 1, "retryable"), (3, "sms", 2, "ok"), (4, "pay", 3, "retryable"), (5, "pay", 3, "retryable"), (6, "pay", 4, "retryable")], "event_id bigint, key string, s int, outcome string")
    past = past.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("s")))
    links = last_links(fold(state.call_inputs(past), ["key"], machine), ["key"], machine)
    assert sorted((r.key, r.state, r.since) for r in links.collect()) == [("crm", 2, None), ("pay", -1, 1), ("sms", 0, None)]
    feed = Feed(spark, lambda s: machines.circuit_breaker_stream(s, failures=3, open_s=30, initial=links))
    got = feed.send([hit(7, "crm", 10, outcome="retryable"), hit(8, "pay", 11, outcome="ok"), hit(9, "pay", 34, outcome="ok"), hit(10, "sms", 12, outcome="retryable")])
    assert [(r[0], r[2], r[3]) for r in got] == [(7, True, "open"), (8, False, "open"), (9, True, "closed"), (10, True, "closed")]


def test_time_to_live_in_processing_time(spark):
    feed = Feed(spark, lambda s: machines.first_claim_stream(s, ttl_s=60, store_ttl_s=3600))
    assert feed.send([hit(1, "a", 0)], [hit(2, "a", 30)], endless=True) == [(1, "a", 1, True), (2, "a", 1, False)]


def test_stream_equals_batch(spark):
    rows = [hit(i, "ab"[i % 3 == 0], i * i % 37 + 30 * (i // 10), outcome=["retryable", "ok", "retryable", "retryable"][i % 4]) for i in range(60)]
    feed = Feed(spark, lambda s: machines.circuit_breaker_stream(s, failures=2, open_s=9))
    rows.sort(key=lambda r: (r["ts"], r["event_id"]))
    got = feed.send(*(rows[i : i + 7] for i in range(0, 60, 7)))
    table = spark.createDataFrame([(r["event_id"], r["key"], r["ts"], r["outcome"]) for r in rows], "event_id bigint, key string, ts string, outcome string")
    assert got == sorted(map(tuple, state.circuit_breaker(table, failures=2, open_s=9).collect()))


def test_quiet_stream_in_processing_time_is_idle(spark):
    folder, out = tempfile.mkdtemp(), []
    with open(f"{folder}/0.json", "w") as file:
        file.write(json.dumps(hit(1, "a", 0)) + "\n")
    source = spark.readStream.schema(SCHEMA).json(folder)
    claims = machines.first_claim_stream(source, ttl_s=60, store_ttl_s=3600)
    query = claims.writeStream.outputMode("append").foreachBatch(lambda df, n: out.append((n, len(df.collect())))).option("checkpointLocation", f"{folder}/_state").start()
    for _ in range(120):
        if out or query.exception():
            break
        time.sleep(0.5)
    time.sleep(5)
    query.stop()
    assert out == [(0, 1)]
    machines.first_claim_stream(source, ttl_s=60)  # timers of event time need batches without data
    assert spark.conf.get(machines.NO_DATA) == "true"
