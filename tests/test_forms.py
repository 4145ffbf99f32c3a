"""Grids, numbers and titles of activity pages, core statements and statements of pages, on odd input."""

import pytest
from pyspark.sql import functions as F

from quern.functions import forms
from quern.operators import switches


def each(spark, values, rule):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["x"] for r in rows.select("i", rule(F.col("t")).alias("x")).orderBy("i").collect()]


GRIDS = [
    (None, None),
    ("", None),
    ("not json", None),
    ('["a:", "b"]', None),
    ("[[]]", {}),
    ('[["A:"]]', {}),
    ('[["A:", "b", null, " C/d : "], [" x  y ", "z"]]', {"a": "x y", "c_d": None}),
    ('[["A:"], null, ["B:"], [2.50]]', {"a": None, "b": "2.5"}),
    ('[null, ["v"], ["A:"], [""]]', None),
    ('[["v"], null, ["A:"], [""]]', {"a": None}),
    ('[["A:", "a:"], ["1", "2"], ["A :"], ["3"], ["A:"]]', {"a": "3"}),
    ('[["LMI%:", "--:"], ["7", "8"]]', {"lmi": "7", "": "8"}),
]


def test_grid_fields(spark):
    assert each(spark, [g for g, _ in GRIDS], lambda c: forms.grid_fields(forms.read_grid(c))) == [m for _, m in GRIDS]


def test_grid_text(spark):
    given = ['[["a ", null], ["", " b\\n c"], null, [3]]', '["x", " ", null, "y"]', "[]", "{}", "no", "", None]
    assert each(spark, given, forms.grid_text) == ["a\nb c\n3", "x\ny", "", "", "", "", ""]


CODES = [
    (None, None, None),
    ("", None, None),
    ("Grantee Activity Number: 18-1_A Activity Title:  Repair  of homes \nx", "18-1_A", "Repair of homes"),
    ("Grantee Activity Number: projected Activity Title: T", None, "T"),
    ("Grantee Activity Number: 1,234 Activity Title: T", None, "T"),
    ("Grantee Activity Number: A1B\nBudget", "A1B", None),
    ("Grantee Activity Number: 12\nBudget", None, None),
    ("Grantee Activity Number: glo-x\r\n\r\nactivity title: Roads", "glo-x", "Roads"),
    ("Grantee Activity Number:\nActivity Title:\nGLO-Admin: Staff  and rent", "GLO-Admin", "Staff and rent"),
    ("Grantee Activity Number:\nN/A x\n$1,000.00\n7: x\nB2C", "B2C", None),
    ("Grantee Activity Number:\n1\n2\n3\n4\n5\n6\nB2C last line that counts", "B2C", "last line that counts"),
    ("Grantee Activity Number:\n1\n2\n3\n4\n5\n6\n7\nB2C too late", None, None),
    ("Grantee Activity Number:\nno\nthe grantee activity number\nD4E title", "D4E", "title"),
    ("Grantee Activity Number:\n" + "x1" * 61 + "\n", None, None),
]


def test_code_and_title(spark):
    got = each(spark, [t for t, *_ in CODES], forms.code_and_title)
    assert [(x["code"], x["title"]) if x else (None, None) for x in got] == [(c, t) for _, c, t in CODES]


def test_activity_number(spark):
    given = ["x\n18-417-000_MI Admin\ny", "72090001-Admin", "72090-Admin", "say\n glo-admin x", "say glo-admin", "Grantee Activity Number: A1B\n18-417-000", None]
    assert each(spark, given, forms.activity_number) == ["18-417-000_MI Admin", "72090001-Admin", None, "glo-admin", None, "A1B", None]


def test_category_and_status(spark):
    given = ["Activity Category: Activity Status:\nPlanning  Under Way\nx", "Activity Category: Activity Status: completed", "Activity Category: Activity Status:\nPlanning", "Planning Under Way", None]
    got = each(spark, given, forms.category_and_status)
    assert [(x["category"], x["status"]) for x in got] == [("Planning", "Under Way"), (None, "Completed"), ("Planning", None), (None, None), (None, None)]


def test_activity_block(spark):
    text = "Grantee Activity Number: A1B Activity Title: Homes\nProject # / Project Title: 0012 / Repair\nResponsible Organization: City  of X\nProjected Start Date: 1/02/2020\nProjected End Date: soon\nNational Objective:  Urgent"
    got = each(spark, [text, "", None], forms.activity_block)
    want = {"grantee_activity_number": "A1B", "activity_title": "Homes", "project_number": "0012", "project_title": "0012 / Repair", "responsible_organization": "City of X", "projected_start_date": "1/02/2020", "national_objective": "Urgent"}
    assert {k: v for k, v in got[0].asDict().items() if v is not None} == want
    assert all(v is None for x in got[1:] for v in x.asDict().values())


CORES = [
    (None, "move", ""),
    ("  ", "move", ""),
    ("Need was high. The city moved  funds away! More.", "move", "The city moved funds away!"),
    ("The storm had changed what the county needed most. The city then moved funds to drainage; more.", "move", "The storm had changed what the county needed most. The city then moved funds to drainage;"),
    ("A. " + "b" * 270 + ". The city then moved funds to drainage", "move", "The city then moved funds to drainage"),
    ("moved funds " + "x" * 600, "move", "moved funds " + "x" * 508 + "…"),
    ("y" * 500, "move", "y" * 420 + "…"),
    ("First they reallocated it. Then they moved funds.", "reallocat", "First they reallocated it."),
    ("First they reallocated it. Then they moved funds.", "none of these", "First they reallocated it."),
]


def test_core_statement(spark):
    rows = spark.createDataFrame([(i, t, k) for i, (t, k, _) in enumerate(CORES)], "i int, t string, k string")
    got = [r["x"] for r in rows.select("i", forms.core_statement(F.col("t"), F.col("k")).alias("x")).orderBy("i").collect()]
    assert got == [w for *_, w in CORES]


@pytest.fixture()
def pages(spark):
    said = "They moved funds from homes to roads because the grant was late."
    return spark.createDataFrame(
        [(1, 1, f"a\n\n{said}\nb"), (1, 2, "\n".join([said, said.upper()] * 4)), (2, 1, "Budget was reallocated to other works of the town."), (2, 2, None), (3, 1, ""), (4, 1, "the grant moved on and nothing was changed"), (None, None, said)],
        "document_id long, page_number long, text string",
    )


def test_statements(spark, pages):
    orgs = spark.createDataFrame(
        [(2, 1, "Town", None), (2, 1, "x", "County  Board"), (2, 1, "y", "County Board"), (2, 1, "HUD", None), (2, 1, "ab", None), (2, 1, None, None), (1, 1, "HUD", None)], "document_id long, page_number long, entity_text string, normalized_text string"
    )
    money = spark.createDataFrame([(2, 1, None, 5.0), (2, 1, "budget", 1.25), (2, 1, "budget", 2.0), (2, 1, "other", 9.0)], "document_id long, page_number long, context_label string, amount_usd double")
    got = switches.statements(pages, switches.top_orgs(orgs), switches.money_by_page(money)).collect()
    one = {(x["document_id"], x["page_number"]): x for x in got}
    assert one[2, 1]["orgs_on_page"] == "County Board; Town" and one[2, 1]["score"] == 1 and one[2, 1]["money_sum_budget"] == 3.25 and one[2, 1]["money_n_unknown"] == 1
    assert one[1, 1]["snippet"] == "a They moved funds from homes to roads because the grant was late. b" and one[1, 1]["orgs_on_page"] is None and one[1, 1]["money_n_budget"] == 0
    # eight equal lines but for case: the windows differ by their number of lines alone
    assert sorted(len(x["snippet_full"]) for x in got if x["page_number"] == 2) == [194, 259, 324]
    assert (None, None) in one and set(one) == {(1, 1), (1, 2), (2, 1), (None, None)}
    summary = {x["document_id"]: x[1:] for x in switches.document_summary(switches.statements(pages, switches.top_orgs(orgs))).collect()}
    assert summary == {1: (4, 0, 4, 0), 2: (1, 0, 0, 1), None: (1, 0, 1, 0)}
    assert switches.statements(pages.limit(0), switches.top_orgs(orgs.limit(0)), switches.money_by_page(money.limit(0))).count() == 0
