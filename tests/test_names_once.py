"""Rules of organisations judge each different text once."""

from quern.operators import resolve


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_organisations(spark):
    rows = [(i, t) for i, t in enumerate(["City of X", "Total Budget", None, "", "HUD", "City of X", "B-17-DM-48-0001", "a: b"])]
    m = spark.createDataFrame(rows, "id long, entity_text string")
    found = resolve.organisations(m, candidates=False)
    assert sorted(r["id"] for r in found.collect()) == [0, 4, 5]
    rules = [line for line in optimized(found).splitlines() if "total budget" in line]
    assert rules and all("Filter" in line and "_n#" in line for line in rules)
    assert sorted(r["id"] for r in resolve.organisations(m, seeds=("Total Budget",)).collect() if r["entity_text"] == "Total Budget") == [1]


def test_aliases(spark):
    m = spark.createDataFrame([("City of X",), ("City of X",), ("Total Budget",), ("Total Budget",), ("CITY OF X",), (None,)], "entity_text string")
    found = resolve.org_aliases(m, least=2)
    assert [r["alias"] for r in found.collect()] == ["City of X"]
    rules = [line for line in optimized(found).splitlines() if "total budget" in line]
    assert rules and all("n#" in line for line in rules)
