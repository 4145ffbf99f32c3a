"""Registered queries over activity pages' grids and numbers, and over statements of switched funds."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import forms
from quern.operators import switches
from quern.registry import register
from quern.sources.tables import table


@register(
    "activity_grids",
    """SELECT o_orderkey, 4::INTEGER AS fields, o_orderpriority AS activity_type, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus ELSE 'again' END AS activity_status, CAST(o_orderkey AS VARCHAR) AS project_number,
CASE WHEN o_orderkey % 3 > 0 THEN 't ' || o_orderpriority END AS project_title, CAST(9 + (o_orderkey % 3 > 0)::INT + 2 * (o_orderkey % 5 > 0)::INT AS INTEGER) AS cells FROM orders""",
)
def activity_grids(spark, d):
    """an order's grid as JSON, read back. Every third grid has a row that ends early, every fifth a last row of
    labels without values; else a label occurs twice."""
    key, none = F.col("o_orderkey"), F.lit(None).cast("string")
    row = lambda *cells: F.array(*[c if not isinstance(c, str) else F.lit(c) for c in cells]).cast("array<string>")
    short, title = row(key.cast("string")), row(key.cast("string"), none, F.concat(F.lit("  t "), "o_orderpriority"))
    rows = F.array(
        row("Activity Type:", none, "Activity Status:"), row(F.col("o_orderpriority"), none, F.col("o_orderstatus")), row("Project Number:", none, "Project Title :"), F.when(key % 3 == 0, short).otherwise(title),
        row("Total Budget", "activity  status:"), F.when(key % 5 > 0, row("x", "again")),
    )
    written = table(spark, d, "orders").select("o_orderkey", F.to_json(F.filter(rows, lambda r: r.isNotNull())).alias("json"))
    read = written.select("o_orderkey", forms.grid_fields(forms.read_grid(F.col("json"))).alias("m"), forms.grid_text(F.col("json")).alias("text"))
    named = [F.try_element_at("m", F.lit(k)).alias(k) for k in ("activity_type", "activity_status", "project_number", "project_title")]
    return read.select("o_orderkey", F.size("m").alias("fields"), *named, F.size(F.split("text", "\n")).alias("cells"))


@register(
    "activity_numbers",
    """WITH t AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k, o_orderkey % 7 AS form, lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS three, o_clerk FROM (SELECT *, 'Clerk ' || (o_custkey % 10) AS o_clerk FROM orders)),
f AS (SELECT *, CASE form WHEN 0 THEN 'GLO-' || k WHEN 1 THEN 'A10' || k WHEN 2 THEN 'B10' || k END AS code FROM t)
SELECT o_orderkey, code, CASE form WHEN 0 THEN o_clerk WHEN 1 THEN 'repair of roads' WHEN 2 THEN 'Roads and bridges' WHEN 5 THEN o_clerk END AS title,
coalesce(code, CASE form WHEN 3 THEN '18-417-' || three || '_X' WHEN 4 THEN '720900' || three || '-Admin' END) AS number FROM f""",
)
def activity_numbers(spark, d):
    """number and title of a page in one of seven layouts, one of them with the number too many lines below its label."""
    k, three = F.col("o_orderkey").cast("string"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0")
    clerk = F.concat(F.lit("Clerk "), F.col("o_custkey") % 10)
    texts = (
        F.concat(F.lit("Quarter 1\nGrantee Activity Number: GLO-"), k, F.lit(" Activity Title: "), clerk, F.lit("\nend")),
        F.concat(F.lit("Grantee Activity Number: Activity Title:\nBenefit Type:\n$5.00 x\n\nA10"), k, F.lit(",  repair of  roads\nC12 no")),
        F.concat(F.lit("grantee activity number: B10"), k, F.lit("\nActivity Title: Roads  and bridges\nend")),
        F.concat(F.lit("Grantee Activity Number:\na\nb\nc\nd\ne\nf\ng\n18-417-"), three, F.lit("_X\nend")),
        F.concat(F.lit("Page\n720900"), three, F.lit("-Admin\nend")),
        F.concat(F.lit("Grantee Activity Number: $1,000.00 Activity Title: "), clerk),
        F.lit("nothing"),
    )
    pages = table(spark, d, "orders").select("o_orderkey", F.element_at(F.array(*texts), (F.col("o_orderkey") % 7 + 1).cast("int")).alias("text"))
    return pages.select("o_orderkey", forms.code_and_title(F.col("text")).alias("x"), forms.activity_number(F.col("text")).alias("number")).select("o_orderkey", "x.code", "x.title", "number")


#: An order is a page of its customer's document. Its lines hold a statement once or seven times, or one that is none;
#: its organisations and amounts are those of its line items.
_FORMS = (
    "The council moved funds from housing program to the drainage program for a total of $5,000.",
    "Budget was reallocated because of need.",
    "The grant was reprogrammed.",
    "An automatic transfer switch was bought and funds were redirected to it.",
    "We redirect visitors to the other door at the back of the old hall.",
    "Nothing was changed.",
)
_LABELS = ("budget", "obligated", "drawdown", "expended", None, "other")
_STATEMENTS = f"""WITH p AS (SELECT o_custkey AS document_id, o_orderkey AS page_number, o_orderkey % 6 AS form FROM orders),
v AS (SELECT *, [{", ".join(f"'{x}'" for x in _FORMS)}][form + 1] AS said FROM p WHERE form < 3),
l AS (SELECT *, list_concat(['Report of order ' || page_number, 'First line of text'], list_transform(range(CASE form WHEN 2 THEN 7 ELSE 1 END), lambda i: said), ['Last line of text', 'end']) AS lines FROM v),
s AS (SELECT DISTINCT document_id, page_number, form, array_to_string(lines[greatest(i - 2, 1):i + 2], ' ') AS snippet FROM (SELECT *, unnest(range(3, len(lines) - 1)) AS i FROM l)),
g AS (SELECT l_orderkey AS page_number, 'Agency ' || (l_suppkey % 20) AS org, count(*) AS n FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1, 2),
o AS (SELECT page_number, CAST(count(*) AS INTEGER) AS n_orgs, string_agg(org, '; ' ORDER BY n DESC, org) AS orgs FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY page_number ORDER BY n DESC, org) <= 12) GROUP BY 1),
m AS (SELECT l_orderkey AS page_number, count(*) FILTER (l_linenumber % 6 = 0) AS money_n_budget, round(sum(l_extendedprice) FILTER (l_linenumber % 6 = 1), 2) AS money_sum_obligated, max(l_extendedprice) FILTER (l_linenumber % 6 = 4) AS money_max_unknown FROM lineitem GROUP BY 1),
c AS (SELECT *, coalesce(n_orgs, 0) AS k, CASE form WHEN 0 THEN 4 WHEN 1 THEN 1 ELSE 0 END + (coalesce(n_orgs, 0) >= 2)::INT AS score FROM s LEFT JOIN o USING (page_number) LEFT JOIN m USING (page_number) WHERE form = 0 OR coalesce(n_orgs, 0) >= 2),
x AS (SELECT document_id, page_number, ['move', 'reallocat', 'reprogram'][form + 1] AS keyword, CAST(score AS INTEGER) AS score, CASE WHEN score >= 5 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS confidence,
  CASE form WHEN 0 THEN 'housing program' END AS from_text, CASE form WHEN 0 THEN 'the drainage program for a total of $5,000' END AS to_text, form = 1 AS has_justification_cue, k AS n_orgs_on_page, orgs AS orgs_on_page,
  snippet, regexp_extract(snippet, '^[^.]*[.]') AS core, coalesce(money_n_budget, 0) AS money_n_budget, coalesce(money_sum_obligated, 0.0::DOUBLE) AS money_sum_obligated, coalesce(money_max_unknown, 0) AS money_max_unknown FROM c)
"""


def _statements(spark, d, money: bool = True):
    o, items = table(spark, d, "orders"), table(spark, d, "lineitem")
    form = (F.col("o_orderkey") % 6).cast("int")
    said = F.element_at(F.array(*map(F.lit, _FORMS)), form + 1)
    lines = F.concat(F.array(F.concat(F.lit("Report of order "), F.col("o_orderkey")), F.lit("  "), F.lit("First line of text")), F.array_repeat(said, F.when(form == 2, 7).otherwise(1)), F.array(F.lit("Last line of text"), F.lit(""), F.lit("end")))
    pages = o.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("page_number"), F.array_join(lines, "\n").alias("text"))
    owners = o.select(F.col("o_orderkey").alias("page_number"), F.col("o_custkey").alias("document_id"))
    own = items.select(
        F.col("l_orderkey").alias("page_number"), F.when(F.col("l_linenumber") == 7, "HUD").otherwise(F.concat(F.lit("agency "), F.col("l_suppkey") % 20)).alias("entity_text"),
        F.when(F.col("l_linenumber") != 7, F.concat(F.lit("Agency  "), F.col("l_suppkey") % 20)).alias("normalized_text"), F.col("l_extendedprice").alias("amount_usd"),
        F.element_at(F.array(*[F.lit(x).cast("string") for x in _LABELS]), (F.col("l_linenumber") % 6 + 1).cast("int")).alias("context_label"),
    ).join(owners, "page_number")
    return switches.statements(pages, switches.top_orgs(own), switches.money_by_page(own) if money else None)


@register("switch_statements", _STATEMENTS + "SELECT * FROM x")
def switch_statements(spark, d):
    """Statements of pages with their organisations, amounts by label and core sentences."""
    return _statements(spark, d).select(
        "document_id", "page_number", "keyword", "score", "confidence", "from_text", "to_text", "has_justification_cue", "n_orgs_on_page", "orgs_on_page", "snippet", "core", "money_n_budget", "money_sum_obligated", "money_max_unknown"
    )


@register("switch_summary", _STATEMENTS + "SELECT document_id, count(*) AS n_hits, count(*) FILTER (confidence = 'high') AS n_high, count(*) FILTER (confidence = 'medium') AS n_medium, count(*) FILTER (confidence = 'low') AS n_low FROM x GROUP BY 1")
def switch_summary(spark, d):
    """A document's statements by confidence."""
    return switches.document_summary(_statements(spark, d, money=False))
