"""Machines over keyed logs against one pass in order, with hot keys over many pieces, ties and nulls."""

import datetime as dt
import random

import pytest

from tillroll.operators import state

START = dt.datetime(2024, 1, 1)
LOG = "event_id bigint, key string, ts timestamp, issued timestamp, good boolean, outcome string"


def log(seed, n, keys, step):
    """A log of some keys, one of them with most rows; several rows have the same second."""
    r, out, at = random.Random(seed), [], 0
    for i in range(n):
        at += r.choice([0, 0, 1, step])
        key = r.choice(keys) if r.random() < 0.3 else keys[0]
        issued = START + dt.timedelta(seconds=at - at % 40)
        out.append((n - i if i % 5 else i + 10 * n, key, START + dt.timedelta(seconds=at), issued, r.random() < 0.15, r.choice(["ok", "retryable", "retryable", "retryable", "rejected", None])))
    return out


def in_order(rows, key=lambda r: r[1]):
    held = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        held.setdefault(key(r), []).append((int((r[2] - START).total_seconds()), r))
    return held.values()


def windows(rows, length):
    """(event_id, count, holder, seconds until the window ends) by one pass."""
    out = []
    for run in in_order(rows):
        begin = None
        for t, r in run:
            if begin is None or t >= begin + length:
                begin, n, by = t, 0, r[0]
            n += 1
            out.append((r[0], n, by, begin + length - t))
    return out


@pytest.mark.parametrize("seed, piece, length", [(1, 3, 20), (2, 7, 1), (3, 50, 4), (4, 1 << 16, 9), (5, 1, 6), (6, 4, 10_000)])
def test_windows(spark, seed, piece, length):
    rows = log(seed, 400, ["a", "b", None, "c"], 3)
    df = spark.createDataFrame(rows, LOG).repartition(5)
    want = windows(rows, length)
    got = state.rate_limit(df, limit=2, window_s=length, piece=piece).collect()
    assert sorted((r.event_id, r["count"], r.allowed, r.retry_after) for r in got) == sorted((e, n, n <= 2, 0 if n <= 2 else left) for e, n, _, left in want)
    got = state.first_claim(df, ttl_s=length, piece=piece).collect()
    assert sorted((r.event_id, r.claimed_by, r.is_first) for r in got) == sorted((e, by, e == by) for e, _, by, _ in want)


def attempts(rows, limit, ttl):
    out = []
    for run in in_order(rows, lambda r: (r[1], r[3])):
        n, gone = 0, False
        for t, r in run:
            if gone or r[2] >= r[3] + dt.timedelta(seconds=ttl):
                out.append((r[0], "expired"))
                continue
            n += 1
            gone = n > limit or r[4]
            out.append((r[0], "locked" if n > limit else "verified" if r[4] else "wrong"))
    return out


def breaker(rows, failures, wait):
    out = []
    for run in in_order(rows):
        name, n, at = "closed", 0, 0
        for t, r in run:
            if name == "open" and t - at < wait:
                out.append((r[0], False, "open"))
                continue
            name = "half_open" if name == "open" else name
            if r[5] == "ok":
                name, n = "closed", 0
            elif r[5] == "retryable":
                n += 1
                if name == "half_open" or n >= failures:
                    name, at = "open", t
            out.append((r[0], True, name))
    return out


@pytest.mark.parametrize("seed, piece, limit, wait", [(1, 3, 2, 10), (2, 1, 1, 3), (3, 60, 5, 30), (4, 1 << 16, 3, 7), (5, 5, 3, 100_000)])
def test_codes_and_breakers(spark, seed, piece, limit, wait):
    rows = log(seed, 400, ["a", "b", None], 2)
    df = spark.createDataFrame(rows, LOG).repartition(5)
    got = state.otp_attempts(df, limit=limit, ttl_s=30, piece=piece).collect()
    assert sorted((r.event_id, r.outcome) for r in got) == sorted(attempts(rows, limit, 30))
    got = state.circuit_breaker(df, failures=limit, open_s=wait, piece=piece).collect()
    want = breaker(rows, limit, wait)
    assert sorted((r.event_id, r.admitted, r.state) for r in got) == sorted(want) and {s for *_, s in want} >= {"open", "closed"}


def test_a_key_without_end_is_split_and_nothing_is_lost(spark):
    """One key holds all rows: its pieces are finished by more than one task; rows without a time come back with nulls."""
    df = spark.range(60_000).selectExpr("id event_id", "'k' key", "timestamp_seconds(1700000000 + id div 7) ts")
    more = spark.createDataFrame([(-1, "k", None), (None, "k", START)], "event_id bigint, key string, ts timestamp")
    out = state.rate_limit(df.repartition(8).unionByName(more), limit=3, window_s=5, piece=1000)
    rows = out.selectExpr("count(*) n", "sum(count) total", "count_if(count IS NULL) unplaced", "count_if(allowed IS NULL) undecided").first()
    assert rows.n == 60_002 and rows.unplaced == rows.undecided == 2
    # windows of 5 seconds have 35 hits
    assert rows.total == sum(i % 35 + 1 for i in range(60_000))
    assert state.rate_limit(df.limit(0)).count() == 0 and state.circuit_breaker(spark.createDataFrame([], LOG)).count() == 0
