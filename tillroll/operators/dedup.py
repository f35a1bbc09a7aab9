"""Duplicate receipts: against a fixed ledger, as an ordered replay, and by fingerprint."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.sources.scratch import kept

MINUTES, DAYS = 15, 1


def _rule(new: str, old: str) -> Column:
    """The first rule that decides a pair: a reason for a duplicate, or null."""
    a, b = (lambda c, p=p: F.col(f"{p}.{c}") for p in (new, old))
    no_codes = F.array().cast("array<string>")
    stored = F.transform(F.coalesce(b("reference_codes"), no_codes), F.lower)
    shared = F.try_element_at(F.filter(F.coalesce(a("reference_codes"), no_codes), lambda c: F.array_contains(stored, F.lower(c))), F.lit(1))
    differs = lambda x, y: F.coalesce(x != y, F.lit(False))
    return (
        F.when(shared.isNotNull(), F.concat(F.lit("reference:"), shared))
        .when(~a("member_id").eqNullSafe(b("member_id")), None)
        .when(differs(F.nullif(a("merchant_code"), F.lit("")), F.nullif(b("merchant_code"), F.lit(""))), None)
        .when(F.coalesce(F.abs(F.datediff(a("receipt_date"), b("receipt_date"))) > DAYS, F.lit(False)), None)
        .when(F.coalesce(F.abs(a("receipt_time_s") - b("receipt_time_s")) > MINUTES * 60, F.lit(False)), None)
        .otherwise("same purchase")
    )


def _by_code(rows: DataFrame) -> DataFrame:
    """A row for each distinct reference code, in lower case."""
    return rows.withColumn("code", F.explode(F.array_distinct(F.transform("reference_codes", F.lower))))


def match_against_ledger(incoming: DataFrame, ledger: DataFrame) -> DataFrame:
    """D-01a, J-02, J-04: (id, is_duplicate, reason, existing_id) of each incoming row against a fixed ledger.

    Duplicates share a reference code or the member, so rows meet in two equi-joins, on (tenant, cents, code) and
    on (tenant, cents, member), with three keys a row for the band of one cent; receipts that only share a popular
    price don't meet.  A pair found twice has one reason.  Of several duplicates an AWARDED row wins, else the least id.
    """
    new = incoming.withColumn("key", F.explode(F.array(F.col("cents") - 1, F.col("cents"), F.col("cents") + 1)))
    old = ledger.filter("status <> 'REJECTED'")

    def judge(new: DataFrame, old: DataFrame, same: Column) -> DataFrame:
        band = F.col("o.total_amount").between(F.col("n.total_amount") - 0.01, F.col("n.total_amount") + 0.01)
        pairs = new.alias("n").join(old.alias("o"), (F.col("n.tenant_id") == F.col("o.tenant_id")) & (F.col("n.key") == F.col("o.cents")) & same & band)
        return pairs.select(F.col("n.id").alias("id"), F.col("o.id").alias("existing_id"), F.col("o.status").alias("s"), _rule("n", "o").alias("reason")).filter("reason IS NOT NULL")

    by_code = judge(_by_code(new), _by_code(old), F.col("n.code") == F.col("o.code"))
    judged = by_code.unionByName(judge(new, old, F.col("n.member_id").eqNullSafe(F.col("o.member_id"))))
    # one candidate a row is kept before rows meet: the aggregate combines on the map side
    best = judged.groupBy("id").agg(F.min_by(F.struct("existing_id", "reason"), F.struct((F.col("s") != "AWARDED").cast("int"), "existing_id")).alias("b"))
    return incoming.select("id").join(best, "id", "left").select("id", F.col("b").isNotNull().alias("is_duplicate"), F.coalesce("b.reason", F.lit("none")).alias("reason"), F.col("b.existing_id").alias("existing_id"))


#: Entries (receipts, their hubs and neighbouring hubs) that one task decides in order; more are decided in rounds.
FEW = 1 << 19


def _hubs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, hub, live) of the hubs that receipts lie in, and (hub, other) of different hubs whose receipts match, both ways; live ones may be kept.

    A hub is a set of receipts that all match each other: those of one tenant, amount and reference code, and those of one tenant, amount,
    member, merchant, date and time.  So at most one receipt of a hub is ever kept, whatever their number.
    """
    text = lambda *names: F.concat_ws("\1", *(F.coalesce(F.col(c).cast("string"), F.lit("\2")) for c in names))
    sound = rows.filter("id IS NOT NULL AND cents IS NOT NULL")
    codes = _by_code(sound.select("id", "tenant_id", "cents", "reference_codes", "status")).withColumn("hub", text("tenant_id", "cents", "code"))
    same = ["tenant_id", "cents", "member_id", "merchant_code", "receipt_date", "receipt_time_s"]
    bought = sound.select("id", "status", *same).withColumn("hub", text(*same))
    live = F.coalesce(F.col("status") != "REJECTED", F.lit(True)).alias("live")
    held = codes.select("id", F.concat(F.lit("c"), "hub").alias("hub"), live).unionByName(bought.select("id", F.concat(F.lit("b"), "hub").alias("hub"), live))

    code_hubs = codes.select("tenant_id", "code", "cents", F.concat(F.lit("c"), "hub").alias("hub")).distinct()
    near_codes = _pairs(code_hubs, ["tenant_id", "code"], [1])
    buy_hubs = bought.select(*same, F.concat(F.lit("b"), "hub").alias("hub"), F.array().cast("array<string>").alias("reference_codes")).distinct()
    near_buys = _pairs(buy_hubs, ["tenant_id", "member_id"], [0, 1]).filter(_rule("n", "o").isNotNull())
    once = near_codes.select("n.hub", F.col("o.hub").alias("other")).unionByName(near_buys.select("n.hub", F.col("o.hub").alias("other")))
    return held, once.unionByName(once.select(F.col("other").alias("hub"), F.col("hub").alias("other")))


def _pairs(hubs: DataFrame, keys: list[str], ahead: list[int]) -> DataFrame:
    """Pairs (n, o) of different hubs of the same ``keys`` (nulls alike), each pair once, where o's amount is so many cents ahead."""
    new = hubs.withColumn("near", F.explode(F.array(*(F.col("cents") + k for k in ahead))))
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    return new.alias("n").join(hubs.alias("o"), [F.col("n.near") == F.col("o.cents"), *same, (F.col("n.cents") < F.col("o.cents")) | (F.col("n.hub") < F.col("o.hub"))])


def _decide_in_order(rest: DataFrame) -> DataFrame:
    """(id, accepted) of the receipts of ``rest`` (id, live, hubs, others), one after the other in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken: set[str] = set()
        for batch in batches:
            accepted = []
            for live, hubs, others in zip(batch["live"], batch["hubs"], batch["others"], strict=True):
                accepted.append(taken.isdisjoint(others))
                if accepted[-1] and live:
                    taken.update(hubs)
            yield pd.DataFrame({"id": batch["id"], "accepted": accepted})

    return rest.repartition(1).sortWithinPartitions("id").mapInPandas(run, "id bigint, accepted boolean")


def _rounds(mine: DataFrame, near: DataFrame, state: DataFrame, small: Callable, in_order: Callable) -> DataFrame:
    """(id, live, state) of all receipts, ``in`` or ``out``; the last ones are decided in order when they are few."""
    while True:
        placed = mine.select("id", "hub").join(state, "id")
        first = lambda s: F.min(F.when(F.col("live") & (F.col("state") == s), F.col("id")))
        hubs = placed.filter("state <> 'out'").groupBy("hub").agg(first("in").alias("kept"), first("open").alias("open"))
        seen = near.join(hubs.withColumnRenamed("hub", "other"), "other").select("hub", "kept", "open").unionByName(hubs).groupBy("hub").agg(F.min("kept").alias("kept"), F.min("open").alias("open"))
        told = placed.filter("state = 'open'").join(seen, "hub", "left").groupBy("id").agg(F.min("kept").alias("kept"), F.min("open").alias("open"))
        signal = state.join(told, "id", "left")
        before = lambda c: F.coalesce(F.col(c) < F.col("id"), F.lit(False))
        decided = F.when(F.col("state") != "open", F.col("state")).when(before("kept"), "out")
        turn = kept(signal.select("id", "live", decided.when(before("open"), "open").otherwise("in").alias("state"), decided.otherwise("open").alias("waiting")), "state")
        if turn.filter("state = 'open'").isEmpty():
            return turn
        rest = mine.join(turn.filter("waiting = 'open'").select("id"), "id", "left_semi")
        if small(rest):
            return kept(turn.join(in_order(rest), "id", "left").select("id", "live", F.coalesce("now", "waiting").alias("state")), "state")
        state = turn


def replay_dedup(rows: DataFrame, *, few: int = FEW) -> DataFrame:
    """D-01b: (id, accepted, existing_id) when rows arrive in the order of id and only accepted ones are kept.

    An ordered greedy independent set: in each round a receipt falls if a kept one before it matches, and is accepted
    if no undecided one before it does.  Rounds see hubs (see :func:`_hubs`) with their first kept and first undecided
    receipt, never pairs of receipts, so a round is a few joins and aggregates that combine before the shuffle.  When at most
    ``few`` entries are left, one task decides them in order; a chain of receipts that each wait for the one before
    is the case that takes many rounds otherwise.

    Null tenants, members, merchants, dates and times are values like others here, as far as the rule lets them.  Rows without
    id or amount match nothing and are accepted; different rows of one id are one receipt.  Of several kept ones an AWARDED one wins, else
    the least id.
    """
    held, near = _hubs(rows)
    near = kept(near, "near")
    # hubs of one receipt that no other one is near fall out here, before rounds begin
    crowded = held.groupBy("hub").agg((F.max("id") > F.min("id")).alias("many")).filter("many").select("hub")
    mine = kept(held.join(crowded.unionByName(near.select("hub")).distinct(), "hub"), "held")
    state = mine.groupBy("id").agg(F.max("live").alias("live"), F.lit("open").alias("state"), F.lit("open").alias("waiting"))

    def small(some: DataFrame) -> bool:
        return some.count() + some.join(near, "hub").count() <= few

    def in_order(some: DataFrame) -> DataFrame:
        with_near = some.join(near, "hub", "left").withColumn("other", F.explode(F.array_compact(F.array("hub", "other"))))
        around = with_near.groupBy("id").agg(F.max("live").alias("live"), F.collect_set("hub").alias("hubs"), F.collect_set("other").alias("others"))
        return _decide_in_order(around).select("id", F.when(F.col("accepted"), "in").otherwise("out").alias("now"))

    if small(mine):
        state = kept(state.join(in_order(mine), "id").select("id", "live", F.col("now").alias("state")), "state")
    else:
        state = _rounds(mine, near, state, small, in_order)

    status = rows.filter("id IS NOT NULL").groupBy("id").agg(F.min((F.col("status") != "AWARDED").cast("int")).alias("later"))
    winners = mine.join(state.filter("state = 'in' AND live"), "id", "left_semi").join(status, "id").select(F.col("hub").alias("other"), F.struct("later", "id").alias("winner"))
    fallen = mine.select("id", "hub").join(state.filter("state = 'out'"), "id", "left_semi")
    around = near.join(winners, "other").select("hub", "winner").unionByName(winners.select(F.col("other").alias("hub"), "winner"))
    found = fallen.join(around, "hub").filter("winner.id < id").groupBy("id").agg(F.min("winner").alias("winner"))
    decided = found.select("id", F.col("winner.id").alias("existing_id"))
    return rows.select("id").join(decided, "id", "left").select("id", F.col("existing_id").isNull().alias("accepted"), "existing_id")


def fingerprint(receipts: DataFrame) -> DataFrame:
    """F-17: the content fingerprint; cents give the two decimals."""
    from tillroll.operators.ledger import money

    codes = F.filter(F.transform(F.coalesce("reference_codes", F.array().cast("array<string>")), lambda c: F.lower(F.trim(c))), lambda c: c != "")
    identity = F.coalesce(F.array_min(codes), F.nullif(F.col("receipt_no"), F.lit("")), F.lit("?"))
    parts = [F.col("tenant_id"), identity, F.coalesce(F.date_format("receipt_date", "yyyy-MM-dd"), F.lit("?")), money(F.col("cents"))]
    return receipts.withColumn("content_fingerprint", F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 32))


def image_fingerprint(tenant: Column, content: Column) -> Column:
    """F-16."""
    return F.substring(F.sha2(F.concat(F.encode(tenant, "UTF-8"), F.unhex(F.lit("00")), content), 256), 1, 32)


def fingerprint_conflicts(receipts: DataFrame) -> DataFrame:
    """D-02: rows whose (tenant, fingerprint) an earlier row holds.  The least id is found by an aggregate,
    which combines before the shuffle; a hot fingerprint is joined, not windowed."""
    firsts = receipts.groupBy("tenant_id", "content_fingerprint").agg(F.min("id").alias("first_id"))
    return receipts.join(firsts, ["tenant_id", "content_fingerprint"]).filter("id > first_id").select("id", "first_id", "content_fingerprint")
