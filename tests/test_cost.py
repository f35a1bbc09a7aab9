"""What extraction costs: steps that Spark computes once, and sources that all cores share."""

from tillroll.functions import fuzzy
from tillroll.operators import extract
from tillroll.plans import queries

DATA = "/root/testdata/sf0.001"


def test_steps_are_planned_once(spark):
    """Words of one step occur once in the plan, not once for each use of its result."""
    df = spark.createDataFrame([(1, ["HILLTOP BOOKS", "Total 18.00"])], "i int, lines array<string>")
    plan = extract.extract_receipts(df, "2019-06-01")._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(w) for w in ("ก่อนหักส่วนลด", "merchant copy", "customer copy")] == [1, 1, 1]


def test_sources_are_spread_before_their_lines_are_made(spark):
    """A table of one split becomes four parts a core, and no line is made by the task that reads it."""
    parts = 4 * spark.sparkContext.defaultParallelism
    for source in (queries._rendered, queries._layouts, lambda s, p: queries._slips(s, p)[0]):
        df = source(spark, DATA)
        assert df.rdd.getNumPartitions() == parts
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert " AS lines" not in plan[plan.index("Repartition") :]


def test_each_different_text_is_looked_at_once():
    import pyarrow as pa

    seen = []

    def of(texts):
        seen.extend(texts)
        return pa.array([len(t) for t in texts], pa.int32())

    held = pa.array([["ab", "c", None], None, [], ["ab", "ab", "def"]] * 3, pa.list_(pa.string()))
    for part, want in ((held, [[2, 1, None], None, [], [2, 2, 3]] * 3), (held[1:6], [None, [], [2, 2, 3], [2, 1, None], None])):
        seen.clear()
        assert fuzzy.by_text(part, of).to_pylist() == want
        assert sorted(seen) == ["ab", "c", "def"]
