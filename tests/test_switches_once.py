"""Statements of switched funds are cut and judged once."""

from quern.operators import switches


def test_statements_are_judged_once(spark):
    text = "First.\nFunds were kept; the county moved funds from housing program to roads for $5,000. Done.\nLAST\n"
    pages = spark.createDataFrame([(1, 1, text), (1, 2, "First.\nNothing.\n"), (2, 1, None), (2, 2, text + "a\nb\nc\n" + text.upper())], "document_id long, page_number long, text string")
    names = [(1, 1, "  HUD ", None), (1, 1, "x", "City  of A"), (2, 2, "City of A", None), (2, 2, "B", None), (2, 2, None, "County B")]
    orgs = switches.top_orgs(spark.createDataFrame(names, "document_id long, page_number long, entity_text string, normalized_text string"))
    found = switches.statements(pages, orgs)
    got = sorted((r["document_id"], r["page_number"], r["keyword"], r["orgs_on_page"], r["core"]) for r in found.collect())
    core = "the county moved funds from housing program to roads for $5,000."
    assert [g[:4] for g in got] == [(1, 1, "move", "City of A"), (2, 2, "move", "City of A; County B"), (2, 2, "move", "City of A; County B")]
    assert got[0][4] == "Funds were kept; " + core
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and ("reallocat" in line or "regexp_replace" in line) for line in plan.splitlines())
