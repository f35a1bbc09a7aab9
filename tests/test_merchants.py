"""Merchants by a registry: index and operator against comparing everything; defined cases; blocks."""

import random

from pyspark.sql import Row

from tillroll.functions.fuzzy import near_texts
from tillroll.functions.lookup import Keywords, may_differ
from tillroll.operators.extract import extract_receipts
from tillroll.operators.merchants import identify_by

SCHEMA = "code string, name string, tax_id string, keywords array<string>, priority bigint"


def damaged(rng, word):
    """Some letters replaced, dropped or put in."""
    letters = list(word)
    for _ in range(rng.randint(0, 4)):
        at = rng.randrange(len(letters))
        letters[at : at + rng.randint(0, 1)] = rng.choice(["", "q", rng.choice("abcd"), "ก"])
        letters = letters or ["a"]
    return "".join(letters)


def test_letters_that_may_differ():
    assert [may_differ(n, 0.8) for n in (3, 4, 5, 9, 10, 14, 15, 20)] == [0, 0, 1, 1, 2, 2, 3, 4]


def test_index_equals_comparing_everything():
    rng = random.Random(5)
    # few different letters, so that stretches which only just fit or fail are common
    words = sorted({"".join(rng.choice("abcdeก") for _ in range(n)) for n in [3, 4, 5, 6, 8, 9, 10, 12, 14, 15, 17, 21, 30] * 5})
    texts = [""] + [" ".join(damaged(rng, rng.choice(words)) for _ in range(rng.randint(1, 12))) for _ in range(40)] + ["qrst" * 10_000 + words[-1]]
    want = [set() for _ in texts]
    for k, word in enumerate(words):
        if may_differ(len(word), 0.8):
            for i in near_texts(texts, word, 0.8):
                want[i].add(k)
    assert sum(map(len, want)) > 200
    for few in (0, 5, 1000):  # all by index, some, none
        index = Keywords(tuple(words), 0.8, few)
        assert index.near(texts) == want
    assert [index.exact(t) for t in texts] == [{k for k, w in enumerate(words) if w in t} for t in texts]


def test_index_of_nothing():
    index = Keywords((), 0.8)
    assert index.near(["abc", ""]) == [set(), set()] and index.exact("abc") == set()


def test_order_nulls_and_ties(spark):
    registry = spark.createDataFrame([
        ("late", "Late", "1111111111111", ["bluewhale"], 9), ("early", "Early", None, ["greentea", None, ""], 1), ("b", "B", "2222222222222", None, 5), ("a", "A", "2222222222222", None, 5),
        ("last", None, "", ["redhouse"], None), (None, "Nobody", "3333333333333", ["nobody"], 0), ("early", "Early", None, ["greentea"], 1),
    ], SCHEMA)
    lines = {
        1: ["GreenTea", "1-1111 1111 1111-"], 2: ["BLUEWHALE and GREENTEA"], 3: ["2222222222222"], 4: ["blue", None, "8luewhale"], 5: ["bluevhale"], 6: ["REDH0USE"], 7: ["nobody 3333333333333"], 8: None, 9: [], 10: ["111111111111"],
        11: ["reenhouse gr", "eentea"],
    }
    df = spark.createDataFrame([(k, v, "seen text" if k == 10 else None, 1) for k, v in lines.items()], "id int, lines array<string>, merchant_text string, code int")
    want = {1: "late", 2: "early", 3: "a", 4: "late", 5: "late", 6: "last", 7: None, 8: None, 9: None, 10: None, 11: "early"}
    one = identify_by(df, registry)
    assert one.columns == ["id", "lines", "merchant_text", "code", "merchant_code", "merchant"]
    rows = {r.id: r for r in one.collect()}
    assert {k: r.merchant_code for k, r in rows.items()} == want
    assert rows[10].merchant == "seen text" and rows[8].merchant == rows[6].merchant == "unknown" and rows[1].merchant == "Late"
    # blocks of two rows give the same
    assert {r.id: r.merchant_code for r in identify_by(df, registry, block=2).collect()} == want
    exact = {r.id: r.merchant_code for r in identify_by(df, registry, least=None).collect()}
    assert exact == want | {5: None, 11: None}
    assert {r.merchant_code for r in identify_by(df, registry.limit(0)).collect()} == {None}
    assert identify_by(df.limit(0), registry).collect() == []


def test_thousands_of_merchants(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("bcdfghjklmnp") for _ in range(rng.randint(6, 18))) for _ in range(10_000)]
    registry = spark.createDataFrame([(f"c{i}", w, None, [w], i) for i, w in enumerate(words)], SCHEMA)
    texts = [f"shop {damaged(rng, rng.choice(words))} street {rng.randint(1, 99)}" for _ in range(60)]
    got = {r.id: r.merchant_code for r in identify_by(spark.createDataFrame([(i, [t]) for i, t in enumerate(texts)], "id int, lines array<string>"), registry).collect()}
    folded = [t.translate(str.maketrans("0158", "oisb")) for t in texts]
    first: dict[int, str] = {}
    for i, word in enumerate(words):
        for j in near_texts(folded, word, 0.8):
            first.setdefault(j, f"c{i}")
    assert got == {j: first.get(j) for j in range(len(texts))} and len(first) > 20


def test_records_by_registry(spark):
    registry = spark.createDataFrame([Row(code="x1", name="Hill Books", tax_id=None, keywords=["hill books"], priority=1)], SCHEMA)
    df = spark.createDataFrame([(1, ["HILL B00KS", "Total 45.00"]), (2, ["LAKE SHOES", "Total 12.50"])], "id int, lines array<string>")
    got = {r.id: (r.merchant_code, r.merchant, r.total_amount) for r in extract_receipts(df, "2024-01-01", registry).collect()}
    assert got == {1: ("x1", "Hill Books", 45.0), 2: (None, "LAKE SHOES", 12.5)}


def test_equal_lines_are_compared_once(spark, monkeypatch):
    """Repeated rows, null ones and null lines keep their number and order; of each different row the index sees one text."""
    import pandas as pd

    from tillroll.operators import merchants

    asked = []

    class Counted(Keywords):
        def near(self, texts):
            asked.extend(texts)
            return super().near(texts)

    monkeypatch.setattr(merchants, "keywords", lambda words, least: Counted(words, least))
    registry = [Row(code="a", name="A", tax_id=None, keywords=["bluewhale"], priority=2), Row(code="b", name="B", tax_id=None, keywords=["greentea"], priority=1)]
    lines = [["bluevhale"], None, ["green", None, "tea"], ["bluevhale"], ["greentea"], [], ["bluevhale"]] * 50
    (got,) = merchants.finder(registry).func(iter([pd.Series(lines)]))
    want = ["a", None, "b", "a", "b", None, "a"] * 50
    assert [None if x is pd.NA else x for x in got["code"]] == want
    assert len(asked) == len(set(asked)) <= 4
    rows = [(i, x) for i, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "id int, lines array<string>")
    table = spark.createDataFrame([tuple(r) for r in registry], SCHEMA)
    for block in (1, 10):
        assert {r.id: r.merchant_code for r in identify_by(df, table, block=block).collect()} == dict(enumerate(want))


def test_index_of_many_letters_is_small():
    """Long keywords of many different letters: the index grows with their letters, not with pairs times keywords."""
    import tracemalloc

    rng = random.Random(9)
    words = tuple({"".join(chr(0x4E00 + rng.randrange(300)) for _ in range(rng.randint(15, 24))) for _ in range(4000)})
    texts = [f"abc {damaged(rng, rng.choice(words))} xyz" for _ in range(40)]
    tracemalloc.start()
    got = Keywords(words, 0.8).near(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = [{k for k, word in enumerate(words) if near_texts([t], word, 0.8)} for t in texts]
    assert got == want and sum(map(len, want)) > 20
    assert peak < 200 << 20
