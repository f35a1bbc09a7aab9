"""Streaming forms: job status, queue messages and what is waiting."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tillroll.sources.derived import parse_jobs
from tillroll.sources.store import exists

def job_status_stream(events: DataFrame, *, ttl_s: int = 3600, late: str = "10 minutes") -> DataFrame:
    """T-03 on a stream of (key, ts, event_id, event_type): (key, state, ts) of each key whose latest state changes.

    ``ttl_s`` after its latest event, in event time, a key's state is dropped and a row with a null state says so.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["key", "state", "ts"]
        if state.hasTimedOut:
            _, ts, _ = state.get
            state.remove()
            yield pd.DataFrame([(key[0], None, pd.Timestamp(ts, unit="us"))], columns=columns)
            return
        last = None
        for rows in batches:
            micros = rows["ts"].astype("datetime64[us]").astype("int64")
            last = max(filter(None, [last, max(zip(micros, rows["event_id"], rows["event_type"], strict=True), default=None)]), default=None)
        held = state.get if state.exists else None
        if last is None or (held is not None and (held[1], held[2]) >= last[:2]):
            return
        ts, event, name = last
        state.update((name, int(ts), int(event)))
        state.setTimeoutTimestamp(max(int(ts) // 1000 + ttl_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], name, pd.Timestamp(ts, unit="us"))], columns=columns)

    marked = events.withWatermark("ts", late)
    return marked.groupBy("key").applyInPandasWithState(step, "key bigint, state string, ts timestamp", "state string, ts bigint, event bigint", "update", GroupStateTimeout.EventTimeTimeout)


def jobs_to_tables(messages: DataFrame, jobs_path: str, bad_path: str, checkpoint: str):
    """S-14, Q12: queue messages into a table of jobs and one of bad messages, resumed from ``checkpoint``."""

    def write(batch: DataFrame, number: int) -> None:
        for rows, path in zip(parse_jobs(batch), (jobs_path, bad_path), strict=True):
            rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def queue_depth(spark: SparkSession, folder: str, checkpoint: str) -> int:
    """S-15: the messages of a folder that a stream over its files (one message a line) hasn't finished.

    The stream's own log tells the files of each batch, and its commits which batches are done; a batch that was begun counts as waiting.
    """
    plain = lambda path: F.regexp_replace(path, "^([a-z]+):///", "$1:/").alias("path")  # noqa: E731  the log and the reader write one path in two ways
    waiting = spark.read.schema("value string").text(folder).select(plain(F.col("_metadata.file_path")))
    if exists(f"{checkpoint}/commits") and exists(f"{checkpoint}/sources/0"):
        commits = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9]*").load(f"{checkpoint}/commits")
        done = commits.agg(F.max(F.element_at(F.split("path", "/"), -1).cast("bigint")).alias("done"))
        log = spark.read.text(f"{checkpoint}/sources/0").select(F.from_json("value", "path string, batchId bigint").alias("x")).filter("x.path IS NOT NULL")
        # one row: the last batch that is done
        finished = log.join(F.broadcast(done), F.col("x.batchId") <= F.col("done")).select(plain(F.col("x.path"))).distinct()
        waiting = waiting.join(finished, "path", "left_anti")
    return waiting.count()
