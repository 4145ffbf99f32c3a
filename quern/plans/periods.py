"""Registered queries over periods: changes, splits, pivots, flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import changes as ch
from quern.operators import flows
from quern.registry import register
from quern.sources.tables import VIEWS, activities, allocations, table

STATUSES = ["Completed", "Under Way", "Cancelled"]

CHANGES = (
    VIEWS
    + """, q AS (SELECT quarter, year, quarter_num, dense_rank() OVER (ORDER BY year, quarter_num) AS position FROM (SELECT DISTINCT quarter, year, quarter_num FROM activities)),
one AS (SELECT activity_code, position, total_budget, status FROM activities JOIN q USING (quarter, year, quarter_num)
  QUALIFY row_number() OVER (PARTITION BY quarter, activity_code ORDER BY id DESC) = 1)
SELECT * FROM (
SELECT coalesce(o.activity_code, n.activity_code) AS activity_code, f.quarter AS from_quarter, t.quarter AS to_quarter,
  round(coalesce(n.total_budget, 0) - coalesce(o.total_budget, 0), 2) AS budget_change,
  CASE WHEN o.status IS NULL THEN 'New' WHEN n.status IS NULL THEN 'Removed' WHEN o.status <> n.status THEN o.status || ' -> ' || n.status END AS status_change
FROM one o FULL OUTER JOIN one n ON o.activity_code = n.activity_code AND o.position + 1 = n.position
JOIN q t ON t.position = coalesce(n.position, o.position + 1) JOIN q f ON f.position = t.position - 1)
WHERE budget_change <> 0 OR status_change IS NOT NULL"""
)


@register("quarter_changes", CHANGES)
def quarter_changes(spark, d):
    return ch.period_changes(activities(spark, d))


@register("latest_of_each_activity", VIEWS + "SELECT activity_code, quarter, status, total_budget, id FROM activities QUALIFY row_number() OVER (PARTITION BY activity_code, quarter ORDER BY id DESC) = 1")
def latest_of_each_activity(spark, d):
    return ch.last_of_each(activities(spark, d), ["activity_code", "quarter"], "id").select("activity_code", "quarter", "status", "total_budget", "id")


@register(
    "zip_allocation_split",
    VIEWS
    + """, s AS (SELECT DISTINCT activity_code, quarter, zip, total FROM allocations JOIN (SELECT activity_code, quarter, round(sum(allocated), 2) AS total FROM allocations GROUP BY 1, 2) USING (activity_code, quarter)),
n AS (SELECT activity_code, quarter, count(DISTINCT zip) AS n FROM s GROUP BY 1, 2)
SELECT zip, quarter, round(sum(total / n), 2) AS total, count(DISTINCT activity_code) AS activities FROM s JOIN n USING (activity_code, quarter) GROUP BY 1, 2""",
)
def zip_allocation_split(spark, d):
    return ch.total_split_evenly(allocations(spark, d), ["activity_code", "quarter"], "zip", "allocated")


@register("status_pivot", VIEWS + "SELECT county, count(*) FILTER (status = 'Completed') AS completed, count(*) FILTER (status = 'Under Way') AS under_way, count(*) FILTER (status = 'Cancelled') AS cancelled FROM activities WHERE county IS NOT NULL GROUP BY 1")
def status_pivot(spark, d):
    return ch.pivot_counts(activities(spark, d), "county", "status", STATUSES)


@register("distinct_pivot", VIEWS + "SELECT quarter, count(DISTINCT activity_code) FILTER (status = 'Completed') AS completed, count(DISTINCT activity_code) FILTER (status = 'Under Way') AS under_way, count(DISTINCT activity_code) FILTER (status = 'Cancelled') AS cancelled FROM activities GROUP BY 1")
def distinct_pivot(spark, d):
    return ch.pivot_distinct(activities(spark, d), "quarter", "status", STATUSES, "activity_code")


@register("activity_first_known", VIEWS + "SELECT activity_code, arg_min(responsible_org, id) FILTER (responsible_org IS NOT NULL) AS responsible_org, arg_min(county, id) FILTER (county IS NOT NULL) AS county, arg_min(status, id) AS status FROM activities GROUP BY 1")
def activity_first_known(spark, d):
    return ch.first_known(activities(spark, d), ["activity_code"], ["id"], ["responsible_org", "county", "status"])


@register("mode_of_type", VIEWS + "SELECT county, activity_type, n FROM (SELECT county, activity_type, count(*) AS n FROM activities GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY county ORDER BY n DESC, activity_type) = 1")
def mode_of_type(spark, d):
    return ch.mode(activities(spark, d), "county", "activity_type")


FLOW = (
    VIEWS
    + """, flow AS (SELECT * FROM (SELECT 0 AS level, 'HUD' AS source, 'GLO' AS target, round(sum(total_budget), 2) AS amount FROM activities
UNION ALL SELECT 1, 'GLO', program_type, round(sum(total_budget), 2) FROM activities GROUP BY program_type
UNION ALL SELECT 2, program_type, coalesce(responsible_org, 'Unknown'), round(sum(total_budget), 2) FROM activities GROUP BY program_type, coalesce(responsible_org, 'Unknown')) WHERE amount > 0)
"""
)


@register("flow_links", FLOW + "SELECT level, source, target, amount FROM flow")
def flow_links(spark, d):
    return flows.links(activities(spark, d), ["program_type", "responsible_org"], "total_budget")


@register("flow_nodes", FLOW + "SELECT node, level, round(sum(inflow), 2) AS inflow, round(sum(outflow), 2) AS outflow FROM (SELECT source AS node, level, 0 AS inflow, amount AS outflow FROM flow UNION ALL SELECT target, level + 1, amount, 0 FROM flow) GROUP BY 1, 2")
def flow_nodes(spark, d):
    return flows.nodes(flow_links(spark, d))


@register("recipient_flow", VIEWS + "SELECT 1 AS level, coalesce(responsible_org, 'Unknown') AS source, coalesce(county, 'Statewide') AS target, round(sum(total_budget), 2) AS amount FROM activities GROUP BY 2, 3 HAVING sum(total_budget) > 0")
def recipient_flow(spark, d):
    a = activities(spark, d).withColumns({"responsible_org": F.coalesce("responsible_org", F.lit("Unknown")), "county": F.coalesce("county", F.lit("Statewide"))})
    return a.groupBy(F.lit(1).alias("level"), F.col("responsible_org").alias("source"), F.col("county").alias("target")).agg(F.round(F.sum("total_budget"), 2).alias("amount")).where("amount > 0")


@register("unprocessed_customers", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def unprocessed_customers(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return ch.missing_from(table(spark, d, "customer").select("c_custkey", "c_name"), done, "c_custkey")
