"""Amounts and names of one unit: links are distinct before they are joined."""

from quern import registry


def test_links(spark, tmp_path):
    rows = [(1, "O", 1, 1), (1, "O", 1, 1), (1, "O", 3, 2), (1, "F", 7, 3), (1, "F", 7, 4), (1, "O", 2, 5), (2, "O", 5, 1), (None, "O", 1, 1), (None, "F", 1, 2)]
    spark.createDataFrame(rows, "l_orderkey long, l_linestatus string, l_partkey long, l_linenumber long").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = registry.queries()["money_entity_links"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(1, a, kind, name) for a in (1, 2) for kind, name in (("ORG", "n7"), ("TX_COUNTY", "n2"))]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")
