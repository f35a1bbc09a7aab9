"""Parsers on literal lines; duplicates and folds on small ledgers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillroll.functions.parsing import amounts, best_amount, find_date, find_time, receipt_no
from tillroll.functions.privacy import has_injection, mask_text, normalize_phone, otp_hash, points
from tillroll.operators import dedup, extract, ledger, state


def column(spark, values, kind, expression):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}").repartition(1)
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_amounts_by_rule(spark):
    """What looks like money and is none: clocks, month and numeric dates, numbers behind labels, long numbers and cut thousands."""
    money = {"Tea 41.5O 43.50": 43.5, "Due 61-25": 61.25, "Sum 7,310": 7310.0, "฿904.10 of 950.20": 950.2, "Pay THB 12 then 8.75": 8.75, "๓๒.๕๐": 32.5, "12.00 9": 12.0, "3 1,002.40": 1002.4}
    other = ["at 08:49", "at 08:49.33", "Mar 3, 2021", "printed 9/11/21", "trace 55120", "#9921", "40718229", "worth 5,20", "Net 0.00", "2,500,000.00", "", "no digits"]
    cases = money | dict.fromkeys(other)
    assert column(spark, list(cases), "string", lambda x: best_amount(amounts(x))) == list(cases.values())


def test_dates_by_rule(spark):
    """Month names win over numbers, repeats over single dates; Buddhist years are read, years far from today and impossible days are not."""
    day = dt.date
    cases = [
        (["14/02/2019", "Feb 9, 2019"], day(2019, 2, 9)), (["9 Feb 2019"], day(2019, 2, 9)), (["01-03-62"], day(2019, 3, 1)), (["01.03.2562"], day(2019, 3, 1)), (["1/3/19"], day(2019, 3, 1)),
        (["05/01/2019", "06/01/2019", "06/01/2019"], day(2019, 1, 6)), (["05/01/2019", "date 06/01/2019"], day(2019, 1, 6)), (["30/02/2019"], None), (["01/01/2009"], None), (["1/2-2019"], None), ([], None),
    ]
    got = column(spark, [c[0] for c in cases], "array<string>", lambda x: find_date(x, F.lit("2019-06-01").cast("date")))
    assert got == [c[1] for c in cases]


def test_times_by_rule(spark):
    """The first line with a time counts; six digits are a time on a dated line only; a misread M is enough for the half of the day."""
    cases = [(["x", "07:05"], 25500), (["7:05:09 pm"], 68709), (["12:30 AN"], 1800), (["12:30 P"], 45000), (["25:00", "03:04"], 11040), (["112233"], None), (["03/04/2019 112233"], 40_953), (["11 22 33"], 40_953), ([], None)]
    assert column(spark, [c[0] for c in cases], "array<string>", find_time) == [c[1] for c in cases]


def test_reference_codes_by_rule(spark):
    """Codes stand behind labels, also misread or fused ones; tax numbers of 13 digits, short numbers and numbers behind other words are none."""
    lines = [["lnvoice 88-1402-77"], ["Inv0ice: (90817)"], ["STAN 440917 TRACE 55201x"], ["REF#7781290"], ["Trans 1234567890123"], ["INV 4417"], ["Desk 440917"], ["ref 55201", "REF 55201"], []]
    assert column(spark, lines, "array<string>", extract.reference_codes) == [["88-1402-77"], ["90817"], ["440917", "55201x"], ["7781290"], [], [], [], ["55201"], []]


def test_receipt_numbers(spark):
    """F-15: the first token behind the keyword, without the signs around it; the first line with a keyword decides."""
    lines = [["hello", "Bill No: -A77/3- x"], ["เลขที่ ：５"], ["RECEIPT NO #"], ["nothing"], ["No. 12", "Invoice no 99"], []]
    assert column(spark, lines, "array<string>", receipt_no) == ["A77/3-", "５", None, None, "12", None]


def totals(spark, cases):
    df = spark.createDataFrame(list(enumerate(cases)), "i int, lines array<string>").repartition(1)
    return [tuple(r.total or ()) for r in extract.find_total(df).orderBy("i").select("total").collect()]


def test_each_branch_of_the_total(spark):
    """One made-up receipt for each way to a total, from the surest one down."""
    net = 310.0
    tax = round(net * 0.07, 2)
    sums = [f"goods {net:.2f}", f"levy {tax:.2f}"]
    cases = {
        (net + tax, 100, "keyword and arithmetic"): [*sums, f"Amount due {net + tax:.2f}"],
        (net + tax, 70, "arithmetic"): [*sums, f"paid {net + tax:.2f}", "Grand total 12.40"],
        (91.5, 50, "keyword"): ["soup 40", "rice 51.50", "Net total 91.50"],
        (net + tax, 60, "arithmetic"): [*sums, f"paid {net + tax:.2f}"],
        (18.25, 40, "only marked amount"): ["snack", "฿18.25", "คิว 7"],
        (66.0, 30, "subtotal"): ["stew 66", "Subtotal 66"],
        (120.0, 80, "balance difference"): ["old balance", "500.00", "used", "120.00", "new balance", "380.00"],
        (64.5, 85, "card footer"): ["balance before", "balance behind", "Card no x-1 paid 64.50"],
        (77.0, 45, "keyword"): ["balance a", "balance b", "total amount 77.00"],
        (): ["only words", "and 3 spoons"],
    }
    assert totals(spark, list(cases.values())) == [pytest.approx(k) if k else () for k in cases]


def test_where_a_total_stands(spark):
    """The value may be one or two lines below its word, but not behind a line of change or discount; the last line wins, as each line counts by the least specific word in it."""
    cases = [["Total", "", "84.10"], ["Total", "change", "84.10"], ["Total", "a", "b", "84.10"], ["Total 10.00", "Total 11.00"], ["Grand total 20.00", "Total 19.00"], ["T0tal 5.50"], ["Discount total 3.00"], ["Totally 8.00"], ["TQTAL 21.00"]]
    assert [t[0] if t else None for t in totals(spark, cases)] == [84.1, None, None, 11.0, 19.0, 5.5, None, 8.0, 21.0]


def test_whole_records(spark):
    """Made-up receipts through all steps: a known tax number, a known word, an unknown shop with a branch, and no total."""
    lines = [
        ["Night Market Stall", "Lane Nine", "TAX ID 0105 5510 88013", "4/5/2019 18:20", "STAN 771200", "NOODLE A 45", "2 PLAIN RICE 30.00", "Net total 75.00"],
        ["welcome", "the pizza place", "04/05/2019", "Slice of day 99.00", "total 99.00"],
        ["HILLTOP BOOKS", "North Gate", "Total 18.00"],
        ["HILLTOP BOOKS", "ring us 0105 5510"],
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, lines array<string>").repartition(1)
    rows = extract.extract_receipts(df, "2019-06-01").orderBy("i").collect()
    assert [r.total_amount for r in rows] == [75.0, 99.0, 18.0, None]
    assert [r.merchant_code for r in rows] == ["sizzler", "the-pizza-company", None, None]
    assert [r.rejected for r in rows] == [False, False, False, True]
    assert rows[2].merchant_text == "HILLTOP BOOKS North Gate" and rows[2].merchant == rows[2].merchant_text
    assert [(x.name, x.price) for x in rows[0]["items"]] == [("NOODLE A", 45.0), ("2 PLAIN RICE", 30.0)]
    assert (rows[0].receipt_date, rows[0].receipt_time_s, rows[0].reference_codes) == (dt.date(2019, 5, 4), 66000, ["771200"])


def test_rules_of_a_record(spark):
    """F-22 and F-33: each rule passes, fails or is skipped; only two of them make a proposal doubtful."""
    item = lambda *prices: [("x", p) for p in prices]
    day = dt.date(2019, 6, 1)
    cases = [
        (item(90.0, 10.0), 100.0, day, {"total_in_range", "items_sum", "subtotal_vat", "date_not_in_future", "date_not_too_old"}, set(), True),
        (item(90.0, None), 100.0, day + dt.timedelta(2), {"total_in_range", "date_not_too_old"}, {"items_sum", "date_not_in_future"}, False),
        (item(), 0.5, None, set(), {"total_in_range"}, False),
        (item(None), 500_000.0, day - dt.timedelta(401), {"total_in_range", "date_not_in_future"}, {"date_not_too_old"}, True),
        (item(5.0), None, day, {"date_not_in_future", "date_not_too_old"}, None, False),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, items array<struct<name:string,price:double>>, total double, day date")
    rules = extract.validate(F.col("items"), F.col("total"), F.col("day"), F.lit(day))
    rows = df.withColumn("rules", rules).withColumn("ok", extract.trusted(F.col("total"), F.col("rules"))).orderBy("i").collect()
    for row, (*_, passed, failed, ok) in zip(rows, cases, strict=True):
        assert set(row.rules.passed) == passed and (failed is None or set(row.rules.failed) == failed) and bool(row.ok) == ok


def test_hashes_and_delays(spark):
    """F-41 and F-42 from their definitions."""
    import hashlib

    assert column(spark, ["0891"], "string", lambda x: otp_hash(x, F.lit("42"))) == [hashlib.sha256(b"0891:42").hexdigest()]
    assert column(spark, [2, 3, 5, 6, 9], "int", state.backoff_delay) == [0.5, 1.0, 4.0, 8.0, 8.0]


def test_box_lines(spark):
    """Boxes join a row when they overlap its first box, not a later one, by half of the lower one, and stand from left to right in it."""
    boxes = "array<struct<text:string,x1:int,y1:int,x2:int,y2:int>>"
    tall, low, beside, under = ("tall", 90, 0, 120, 40), ("low", 10, 30, 40, 40), ("beside", 50, 12, 80, 22), ("under", 0, 41, 9, 50)
    assert column(spark, [[low, tall, under, beside], [], [under]], boxes, extract.box_lines) == [["beside tall", "low", "under"], [], ["under"]]


def test_small_functions(spark):
    phones = {"+66 6 1234 5678": "0612345678", "66812340000": "0812340000", "66-0-91-111-2222": "0911112222", "": None, "06123": None, "0312345678": None, "tel 0899999999": "0899999999"}
    assert column(spark, list(phones), "string", normalize_phone) == list(phones.values())
    assert column(spark, [["now ACT AS a poet"], ["tea 12.00", "come again"], ["new instruction:"]], "array<string>", has_injection) == [True, False, True]
    assert column(spark, [10_000, 9_999, 123_456, 0, -20_000], "bigint", points) == [1, 0, 12, 0, 0]


RECEIPT = "id bigint, tenant_id string, member_id bigint, total_amount double, cents bigint, status string, receipt_date date, receipt_time_s int, reference_codes array<string>, merchant_code string"
DAY = dt.date(2026, 6, 6)


def receipt(i, time="17:13", codes=(), member=1, cents=7900, status="AWARDED", day=DAY, shop=None, tenant="A"):
    seconds = None if time is None else int(time[:2]) * 3600 + int(time[3:]) * 60
    return (i, tenant, member, cents / 100, cents, status, day, seconds, list(codes), shop)


def test_duplicates_against_a_ledger(spark):
    old = spark.createDataFrame([receipt(1, codes=["AB12345"], shop="kfc"), receipt(2, status="FAILED", member=2)], RECEIPT)
    new = [
        receipt(10, codes=["ab12345"], member=9), receipt(11, day=DAY + dt.timedelta(1)), receipt(12, time=None), receipt(13, time="17:51"), receipt(14, shop="dq"), receipt(15),
        receipt(16, cents=8000), receipt(17, day=DAY + dt.timedelta(2)), receipt(18, tenant="B"), receipt(19, member=3), receipt(20, cents=7901),
    ]
    got = {r.id: r.is_duplicate for r in dedup.match_against_ledger(spark.createDataFrame(new, RECEIPT), old).collect()}
    assert got == {10: True, 11: True, 12: True, 13: False, 14: False, 15: True, 16: False, 17: False, 18: False, 19: False, 20: True}


def test_replay_compares_with_accepted_rows_only(spark):
    rows = spark.createDataFrame([receipt(1, "17:00"), receipt(2, "17:14"), receipt(3, "17:28")], RECEIPT)
    got = {r.id: (r.accepted, r.existing_id) for r in dedup.replay_dedup(rows).collect()}
    assert got == {1: (True, None), 2: (False, 1), 3: (True, None)}
    assert dedup.replay_dedup(rows.limit(0)).count() == 0


def test_replay_equals_one_sequential_pass(spark):
    from random import Random

    r = Random(7)
    rows = [
        receipt(i, r.choice(["17:00", "17:10", "17:20", None]), r.sample(["AA1", "aa1", "BB2", "CC3"], r.randint(0, 2)), r.choice([1, 2, 3, None]), 1000 + r.randint(0, 12), r.choice(["AWARDED", "FAILED", "REJECTED"]), DAY, r.choice(["kfc", "dq", None]), r.choice("AB"))
        for i in range(150)
    ]
    kept, want = [], {}
    for i, tenant, member, amount, _, status, _, seconds, codes, shop in rows:
        def same(o):
            if o[1] != tenant or abs(o[3] - amount) > 0.01 + 1e-9 or o[5] == "REJECTED":
                return False
            if {c.lower() for c in codes} & {c.lower() for c in o[8]}:
                return True
            return o[2] == member and (None in (shop, o[9]) or shop == o[9]) and (None in (seconds, o[7]) or abs(seconds - o[7]) <= 900)

        best = min((o for o in kept if same(o)), key=lambda o: (o[5] != "AWARDED", o[0]), default=None)
        want[i] = (best is None, best and best[0])
        if best is None:
            kept.append((i, tenant, member, amount, None, status, None, seconds, codes, shop))
    got = {x.id: (x.accepted, x.existing_id) for x in dedup.replay_dedup(spark.createDataFrame(rows, RECEIPT)).collect()}
    assert got == want and not all(a for a, _ in want.values())


def test_replay_in_rounds_and_in_order(spark):
    """The same result by rounds alone, by one task alone and by one pass; hot copies, null tenants, repeated and null ids."""
    from random import Random

    r = Random(11)
    rows = [
        receipt(i, r.choice(["09:00", "09:11", "09:25", None]), r.sample(["K1", "k1", "L2", "M3"], r.randint(0, 2)), r.choice([1, 2, None]), 500 + r.randint(0, 6), r.choice(["AWARDED", "FAILED", "REJECTED"]), r.choice([DAY, None, DAY + dt.timedelta(2)]), r.choice(["a", "", None]), r.choice(["A", None]))
        for i in range(120)
    ]
    rows += [receipt(1000 + i, "10:00", [], 5, 900) for i in range(200)]
    rows += [receipt(2000, "11:00", ["Z"], 6, 700), receipt(2000, "11:00", ["Z"], 6, 700), receipt(None, "11:00", ["Z"], 6, 700), receipt(2001, "12:00", ["z"], 7, 701)]
    df = spark.createDataFrame(rows, RECEIPT)
    kept, want = [], {}
    for row in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        i, tenant, member, _, cents, status, day, seconds, codes, shop = row

        def same(o):
            if o[1] != tenant or abs(o[4] - cents) > 1:
                return False
            if {c.lower() for c in codes} & {c.lower() for c in o[8]}:
                return True
            return o[2] == member and (not (shop and o[9]) or shop == o[9]) and (None in (day, o[6]) or abs((day - o[6]).days) <= 1) and (None in (seconds, o[7]) or abs(seconds - o[7]) <= 900)

        if i in want:
            continue
        best = min((o for o in kept if same(o)), key=lambda o: (o[5] != "AWARDED", o[0]), default=None)
        want[i] = (best is None, best and best[0])
        if best is None and status != "REJECTED":
            kept.append(row)
    for few in (0, 1 << 19):
        got = dedup.replay_dedup(df, few=few).collect()
        assert len(got) == len(rows) and {x.id: (x.accepted, x.existing_id) for x in got if x.id is not None} == want
        assert [x.accepted for x in got if x.id is None] == [True]


def test_metrics_of_tenants_without_receipts(spark):
    tenants = spark.createDataFrame([("A",), ("B",), ("B",)], "tenant_id string")
    none = ledger.status_metrics(spark.createDataFrame([], RECEIPT), tenants).collect()
    assert sorted((r.tenant_id, r.total, r.award_rate, r.needs_attention) for r in none) == [("A", 0, 0.0, False), ("B", 0, 0.0, False)]
    some = spark.createDataFrame([receipt(1, tenant="A", status="DEAD"), receipt(2, tenant="C"), receipt(3, tenant=None)], RECEIPT)
    got = {r.tenant_id: (r.dead, r.total) for r in ledger.status_metrics(some, tenants).collect()}
    assert got == {"A": (1, 1), "B": (0, 0), "C": (0, 1), None: (0, 1)}
    assert {r.tenant_id: r.n for r in ledger.status_count(some, tenants, "DEAD").collect()} == {"A": 1, "B": 0, "C": 0, None: 0}


def test_new_members_have_dense_ids(spark):
    members = spark.createDataFrame([(3, "A", "u1"), (7, "B", "u1")], "id bigint, tenant_id string, line_user_id string")
    asked = [("A", "u1"), ("B", "u9"), ("A", "u5"), ("A", "u5"), (None, "u1"), ("B", None)] + [("C", f"v{i:03d}") for i in range(300)]
    df = spark.createDataFrame(asked, "tenant_id string, line_user_id string").repartition(6)
    rows = sorted((r.id, r.tenant_id, r.line_user_id, r.created) for r in ledger.get_or_create(members, df).collect())
    want = [(8, None, "u1", True), (9, "A", "u5", True), (10, "B", "u9", True)] + [(11 + i, "C", f"v{i:03d}", True) for i in range(300)]
    assert rows == [(3, "A", "u1", False), *want]
    assert sorted(tuple(r) for r in ledger.get_or_create(members, df).collect()) == rows
    assert ledger.get_or_create(members, df.limit(0)).count() == 0


def test_masking_beside_thai_marks(spark):
    cases = {"เบอร์0812345678": "เบอร์081*****78", "ที่0812345678": "ที่081*****78", "ที่token=abc": "ที่token=***", "a+66812345678": "a+66*******78", "+66812345678": "+668******78", "x0812345678": "x0812345678", "ที่Bearer ab.c": "ที่Bearer ***"}
    assert column(spark, list(cases), "string", mask_text) == list(cases.values())


def test_near_texts_equals_all_windows():
    from difflib import SequenceMatcher
    from random import Random

    from tillroll.functions.fuzzy import near_texts

    r = Random(3)
    for _ in range(300):
        word = "".join(r.choice("total ") for _ in range(r.randint(1, 7)))
        texts = ["".join(r.choice("total gx") for _ in range(r.randint(0, 14))) for _ in range(6)]
        for least in (0.5, 0.8):
            want = {i for i, t in enumerate(texts) if any(SequenceMatcher(None, t[j : j + len(word)], word).ratio() >= least for j in range(len(t) - len(word) + 1))}
            assert near_texts(texts, word, least) == want


def test_weak_boxes_go(spark):
    boxes = "array<struct<text:string,x1:int,y1:int,x2:int,y2:int,confidence:double>>"
    got = column(spark, [[("A", 0, 0, 9, 9, 0.9), ("B", 9, 0, 19, 9, 0.49), (" ", 20, 0, 29, 9, 0.9), ("C", 30, 0, 39, 9, None)]], boxes, lambda b: extract.box_lines(b, confidence=True))
    assert got == [["A C"]]
