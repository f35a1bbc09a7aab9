"""Keyed, expiring state over logs: rate limits, claims, job status, one-time codes, circuit breakers.

Rate limits, claims, codes and breakers are machines of a few states (:mod:`tillroll.operators.machine`), whose folds are split over tasks
inside a key.  In all of them a null key is a key like others, and a row without a time or an event_id has null results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.operators.machine import HOLD, PIECE, Machine, fold


def _seconds(name: str) -> Column:
    return F.unix_seconds(F.col(name).cast("timestamp"))


def windows_machine(length_s: int) -> Machine:
    """Windows that a hit outside of any other opens and later hits don't extend: one state, and every hit seen begins a hold."""
    return Machine(((HOLD,),), length_s)


def hit_inputs(hits: DataFrame) -> DataFrame:
    return hits.select("event_id", "key", _seconds("ts").alias("t"), F.lit(0).alias("kind"))


def hit_counts(rows: DataFrame, limit: int, window_s: int) -> DataFrame:
    """What a rate limit says to folded hits."""
    allowed = F.col("since") <= limit
    retry = F.when(allowed, F.lit(0).cast("bigint")).otherwise(F.col("holder_t") + window_s - F.col("t"))
    return rows.select("event_id", "key", F.col("since").alias("count"), allowed.alias("allowed"), F.when(allowed.isNotNull(), retry).alias("retry_after"))


def hit_claims(rows: DataFrame) -> DataFrame:
    """Who holds the claim at folded hits."""
    return rows.select("event_id", "key", F.col("holder").alias("claimed_by"), (F.col("holder") == F.col("event_id")).alias("is_first"))


def rate_limit(hits: DataFrame, *, limit: int = 5, window_s: int = 600, piece: int = PIECE) -> DataFrame:
    """T-01: (event_id, key, count, allowed, retry_after).  A window begins at the first hit, isn't aligned and
    isn't extended; denied hits count too.  ``hits``: event_id, key, ts."""
    return hit_counts(fold(hit_inputs(hits), ["key"], windows_machine(window_s), piece=piece), limit, window_s)


def first_claim(hits: DataFrame, *, ttl_s: int = 300, piece: int = PIECE) -> DataFrame:
    """T-02: (event_id, key, claimed_by, is_first): the first claim in a window wins; the window isn't extended."""
    return hit_claims(fold(hit_inputs(hits), ["key"], windows_machine(ttl_s), piece=piece))


def job_status(events: DataFrame, as_of: str, ttl_s: int = 3600) -> DataFrame:
    """T-03, W-06: the latest state of each key, if it is younger than its time to live at ``as_of``."""
    last = events.groupBy("key").agg(F.max_by(F.struct("event_type", "ts"), F.struct("ts", "event_id")).alias("x")).select("key", F.col("x.event_type").alias("state"), F.col("x.ts").alias("ts"))
    return last.filter(_seconds("ts") + ttl_s > F.unix_seconds(F.lit(as_of).cast("timestamp")))


def code_machine(limit: int) -> Machine:
    """States: 0 to ``limit`` tries counted, then gone.  Inputs: wrong, good, too late."""
    gone = limit + 1
    counted = tuple((n + 1 if n < limit else gone, gone, n) for n in range(limit + 1))
    return Machine((*counted, (gone, gone, gone)))


def code_inputs(attempts: DataFrame, ttl_s: int) -> DataFrame:
    timed = attempts.select("event_id", "key", _seconds("ts").alias("t"), _seconds("issued").alias("issued_s"), F.coalesce("good", F.lit(False)).alias("good"))
    late = F.coalesce(F.col("t") >= F.col("issued_s") + ttl_s, F.lit(True))
    return timed.select("event_id", "key", "issued_s", "t", F.when(late, 2).when(F.col("good"), 1).otherwise(0).alias("kind"))


def code_outcomes(rows: DataFrame, limit: int) -> DataFrame:
    """What folded tries come to."""
    outcome = F.when((F.col("state") == limit + 1) | (F.col("kind") == 2), "expired").when(F.col("state") == limit, "locked").when(F.col("kind") == 1, "verified").otherwise("wrong")
    return rows.select("event_id", "key", F.when(F.col("seen"), outcome).alias("outcome"))


def otp_attempts(attempts: DataFrame, *, limit: int = 5, ttl_s: int = 300, piece: int = PIECE) -> DataFrame:
    """T-04: (event_id, key, outcome) of tries at a code that was issued at ``issued``.

    Order of tests: expired, counted (over the limit: locked and cleared), matching (cleared) or
    wrong.  ``attempts``: event_id, key, ts, issued, good.  A cleared code is expired afterwards.  The tries of one code are
    a fold of their own; the counter lives as long as the code, as no try counts that comes later.  A null
    ``good`` is a wrong try, a code without a time of issue has expired.
    """
    return code_outcomes(fold(code_inputs(attempts, ttl_s), ["key", "issued_s"], code_machine(limit), piece=piece), limit)


def breaker_machine(failures: int, open_s: int) -> Machine:
    """States: 0 to failures - 1 consecutive failures while closed, then half-open.  Inputs: ok, retryable, rejected."""
    closed = tuple((0, n + 1 if n + 1 < failures else HOLD, n) for n in range(failures))
    return Machine((*closed, (0, HOLD, failures)), open_s, failures)


def call_inputs(calls: DataFrame) -> DataFrame:
    kind = F.when(F.col("outcome") == "ok", 0).when(F.col("outcome") == "retryable", 1).otherwise(2)
    return calls.select("event_id", "key", _seconds("ts").alias("t"), kind.alias("kind"))


def call_states(rows: DataFrame, failures: int) -> DataFrame:
    """Whether folded calls were let through, and the breaker's state after each."""
    half = F.col("state") == failures
    opens = (F.col("kind") == 1) & (half | (F.col("state") == failures - 1))
    after = F.when(opens, "open").when(half & (F.col("kind") == 2), "half_open").otherwise("closed")
    return rows.select("event_id", "key", F.col("seen").alias("admitted"), F.when(F.col("seen"), after).when(~F.col("seen"), "open").alias("state"))


def circuit_breaker(calls: DataFrame, *, failures: int = 5, open_s: int = 30, piece: int = PIECE) -> DataFrame:
    """T-05, T-06: (event_id, key, admitted, state) of calls to a service; ``state`` is that after the call.

    ``calls``: event_id, key, ts, outcome (ok, retryable, rejected; others and null count as rejected).  Consecutive retryable failures
    open the breaker; after ``open_s`` one call is let through half-open; success closes it, a failure
    there reopens it.  Rejected calls neither count nor reset.  A call is one that retries have ended on.
    """
    return call_states(fold(call_inputs(calls), ["key"], breaker_machine(failures, open_s), piece=piece), failures)


def backoff_delay(attempt: Column, base: float = 0.5, multiplier: float = 2.0, most: float = 8.0) -> Column:
    """F-42 without the random part: the delay before an attempt from the second on."""
    return F.least(F.lit(base) * F.pow(F.lit(multiplier), attempt - 2), F.lit(most))
