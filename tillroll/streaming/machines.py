"""Claims, one-time codes and circuit breakers as streams: the machines of the batch folds with their state in a state store.

A key's state is one small row, the link between its last row and the next.  It goes by a timer, ``forget_s`` of event time after
the key's latest row, or in processing time by the store's own time to live.  A batch fold's last states can be the
initial state, so a stream goes on where a table ends.

Rows of a key are taken in the order of arrival, sorted inside one Arrow batch; rows that come late but inside the watermark count
on arrival.  No more than one Arrow batch of a key is in memory.  The session needs the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``), see :func:`use_rocksdb`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tillroll.operators import state
from tillroll.operators.machine import ADDED, LINK, Machine, Piece

#: Spark's switch for batches without data; a stream reads it from its session when it starts.
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class MachineProcessor(StatefulProcessor):
    """Runs a machine on the rows of a key.  ``columns``: the names of the rows' columns that stay, keys first."""

    def __init__(self, machine: Machine, columns: list[str], keys: int, forget_s: int | None, ttl_s: int | None):
        self.machine, self.columns, self.keys, self.forget_s, self.ttl_s = machine, columns, keys, forget_s, ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.link = handle.getValueState("link", LINK, 1000 * self.ttl_s if self.ttl_s else None)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self._keep(tuple(None if pd.isna(v := row[c]) else int(v) for c in ("state", "holder", "holder_t", "since")), None, timerValues)

    def _keep(self, link: tuple, t: int | None, timers) -> None:
        self.link.update(link)
        if self.forget_s:
            for at in self.handle.listTimers():
                self.handle.deleteTimer(at)
            now = timers.getCurrentWatermarkInMs()
            self.handle.registerTimer(max(now + 1, 1000 * ((now // 1000 if t is None else t) + self.forget_s)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        link = self.link.get() if self.link.exists() else (0, None, None, None)
        latest = None
        for some in rows:
            placed = some[some["t"].notna() & some["event_id"].notna()].sort_values(["t", "event_id"])
            unplaced = some.drop(placed.index)
            if len(placed):
                piece = Piece(self.machine, np.zeros(len(placed), np.int64), *(placed[c].to_numpy(np.int64) for c in ("t", "kind", "event_id")))
                x, link = piece.columns(link), piece.leaving(link)
                latest = max(filter(None, [latest, int(placed["t"].max())]))
                placed = placed.assign(seen=x["seen"], state=pd.array(np.where(x["seen"], x["state"], 0), "Int32"), **{c: pd.array(x[c], "Int64") for c in ("holder", "holder_t", "since")})
                placed.loc[~x["seen"], "state"] = pd.NA
                placed.loc[~x["inside"], ["holder", "holder_t", "since"]] = pd.NA
            out = pd.concat([placed, unplaced]) if len(unplaced) else placed
            for i, name in enumerate(self.columns[: self.keys]):
                out[name] = key[i]
            yield out.reindex(columns=[*self.columns, *(c.split()[0] for c in ADDED.split(", "))])
        if latest is not None:
            self._keep(link, latest, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.link.clear()
        return iter(())

    def close(self) -> None:
        pass


def machine_stream(rows: DataFrame, keys: list[str], machine: Machine, *, forget_s: int | None = 86_400, store_ttl_s: int | None = None, late: str = "10 minutes", initial: DataFrame | None = None) -> DataFrame:
    """The fold of a machine over a stream of (keys, event_id, ts, t, kind, ...), with the columns ADDED.

    Event time (``forget_s``) needs no clock; with ``store_ttl_s`` instead the state store drops states so many seconds
    of processing time after their last change.  ``initial`` is what :func:`tillroll.operators.machine.last_links` gives.

    In processing time Spark would run one batch without data after the other for ever, so that a quiet stream is never idle.  The store
    hides what is over without them, and event time needs them for its timers: the session's switch is set to
    what this stream needs, so start it before another machine is built.
    """
    rows.sparkSession.conf.set(NO_DATA, str(not store_ttl_s).lower())
    columns = [*keys, *(c for c in rows.columns if c not in (*keys, "ts"))]
    schema = T.StructType([*(T.StructField(c, rows.schema[c].dataType) for c in columns), *T.StructType.fromDDL(ADDED).fields])
    processor = MachineProcessor(machine, columns, len(keys), None if store_ttl_s else forget_s, store_ttl_s)
    marked = rows if store_ttl_s else rows.withWatermark("ts", late)
    return marked.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "ProcessingTime" if store_ttl_s else "EventTime", initialState=initial.groupBy(*keys) if initial is not None else None)


def _with_ts(inputs: DataFrame) -> DataFrame:
    return inputs.withColumn("ts", F.timestamp_seconds("t"))


def rate_limit_stream(hits: DataFrame, *, limit: int = 5, window_s: int = 600, **options) -> DataFrame:
    """T-01 on a stream; a window is forgotten when it is over."""
    options = {"forget_s": window_s, **options}
    return state.hit_counts(machine_stream(_with_ts(state.hit_inputs(hits)), ["key"], state.windows_machine(window_s), **options), limit, window_s)


def first_claim_stream(hits: DataFrame, *, ttl_s: int = 300, **options) -> DataFrame:
    """T-02 on a stream; a claim is forgotten when its time to live is over."""
    options = {"forget_s": ttl_s, **options}
    return state.hit_claims(machine_stream(_with_ts(state.hit_inputs(hits)), ["key"], state.windows_machine(ttl_s), **options))


def otp_attempts_stream(attempts: DataFrame, *, limit: int = 5, code_ttl_s: int = 300, **options) -> DataFrame:
    """T-04 on a stream; the counter of a code is forgotten ``code_ttl_s`` after its last try."""
    options = {"forget_s": code_ttl_s, **options}
    return state.code_outcomes(machine_stream(_with_ts(state.code_inputs(attempts, code_ttl_s)), ["key", "issued_s"], state.code_machine(limit), **options), limit)


def circuit_breaker_stream(calls: DataFrame, *, failures: int = 5, open_s: int = 30, **options) -> DataFrame:
    """T-05 on a stream; a service without calls for ``forget_s`` (a day) begins closed again."""
    return state.call_states(machine_stream(_with_ts(state.call_inputs(calls)), ["key"], state.breaker_machine(failures, open_s), **options), failures)
