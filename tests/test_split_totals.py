"""Totals are split in one pass over their rows."""

from quern import registry
from quern.operators import changes


def test_total_split_evenly(spark):
    rows = [("a", "q1", "1", 1.0), ("a", "q1", "1", 2.0), ("a", "q1", "2", 6.0), ("a", "q2", "1", None), ("b", "q1", "1", 5.0), ("b", "q1", None, 3.0), ("c", "q2", None, 7.0), (None, "q1", "1", 9.0), ("d", None, "1", 9.0)]
    df = spark.createDataFrame(rows, "activity_code string, quarter string, zip string, allocated double")
    got = sorted((tuple(r) for r in changes.total_split_evenly(df, ["activity_code", "quarter"], "zip", "allocated").collect()), key=str)
    assert got == sorted([("1", "q1", 4.5 + 8.0, 2), ("2", "q1", 4.5, 1), ("1", "q2", None, 1), (None, "q1", None, 1), (None, "q2", None, 1)], key=str)


def test_one_pass(spark):
    plan = registry.queries()["zip_allocation_split"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_extendedprice#") and sum("l_orderkey" in x and "Relation" in x for x in plan.splitlines()) == 1 and "collect_set" not in plan
