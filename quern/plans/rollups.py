"""Registered rollups over the report model's views."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import finance as fin
from quern.registry import register
from quern.sources.tables import VIEWS, activities, allocations, table

LATEST = "(SELECT max_by(quarter, year * 10 + quarter_num) FROM activities)"


@register(
    "quarterly_program_summary",
    VIEWS
    + f"""SELECT program_type, count(*) AS activity_count, round(sum(total_budget), 2) AS total_budget,
  round(sum(CASE WHEN status = 'Completed' THEN total_budget END), 2) AS completed_budget,
  count(*) FILTER (status = 'Completed') AS completed, count(*) FILTER (status = 'Under Way') AS in_progress,
  round_even(count(*) FILTER (status = 'Completed') * 100.0::DOUBLE / count(*), 1) AS completion_rate
FROM activities WHERE quarter = {LATEST} GROUP BY 1""",
)
def quarterly_program_summary(spark, d):
    return fin.by_program(fin.in_latest_quarter(activities(spark, d)))


@register("funding_by_county", VIEWS + "SELECT coalesce(county, 'Statewide') AS county, program_type, activity_count, allocated FROM (SELECT county, program_type, count(*) AS activity_count, round(sum(total_budget), 2) AS allocated FROM activities GROUP BY 1, 2)")
def funding_by_county(spark, d):
    return fin.by_place(activities(spark, d), "county", "Statewide")


@register("funding_by_organization", VIEWS + "SELECT coalesce(responsible_org, 'Unknown') AS responsible_org, program_type, activity_count, allocated FROM (SELECT responsible_org, program_type, count(*) AS activity_count, round(sum(total_budget), 2) AS allocated FROM activities GROUP BY 1, 2)")
def funding_by_organization(spark, d):
    return fin.by_place(activities(spark, d), "responsible_org", "Unknown")


@register("quarterly_trends", VIEWS + "SELECT year, quarter_num, quarter, program_type, count(*) AS activity_count, round(sum(total_budget), 2) AS total_budget, count(*) FILTER (status = 'Completed') AS completed FROM activities GROUP BY ALL")
def quarterly_trends(spark, d):
    return fin.quarterly_trend(activities(spark, d))


@register("activity_history", VIEWS + "SELECT activity_code, quarter, year, quarter_num, status, total_budget, id FROM activities WHERE activity_code = 'ACT-7' ORDER BY year, quarter_num, id")
def activity_history(spark, d):
    one = fin.filtered(activities(spark, d), activity_code="ACT-7")
    return one.select("activity_code", "quarter", "year", "quarter_num", "status", "total_budget", "id").orderBy("year", "quarter_num", "id")


@register("completion_rates", VIEWS + "SELECT activity_type, program_type, count(*) AS total, count(*) FILTER (status = 'Completed') AS completed, round(count(*) FILTER (status = 'Completed') * 100.0::DOUBLE / count(*), 1) AS completion_rate FROM activities GROUP BY 1, 2")
def completion_rates(spark, d):
    return fin.completion_rates(activities(spark, d), "activity_type", "program_type")


@register("ledger_summary", VIEWS + "SELECT count(*) AS records, count(DISTINCT activity_code) AS activities, count(DISTINCT responsible_org) AS organizations, count(DISTINCT county) AS counties, round(sum(total_budget), 2) AS total_budget FROM activities")
def ledger_summary(spark, d):
    return fin.summary(activities(spark, d))


@register(
    "local_vs_national",
    VIEWS
    + f"""SELECT n.program_type, n.national, coalesce(l.local, 0) AS local, round(coalesce(l.local, 0) * 100 / nullif(n.national, 0), 2) AS share
FROM (SELECT program_type, round(sum(total_budget), 2) AS national FROM activities GROUP BY 1) n
LEFT JOIN (SELECT program_type, round(sum(total_budget), 2) AS local FROM activities WHERE quarter = {LATEST} AND county = 'ASIA' GROUP BY 1) l USING (program_type)""",
)
def local_vs_national(spark, d):
    a = activities(spark, d)
    national = a.groupBy("program_type").agg(fin.money(F.sum("total_budget")).alias("national"))
    local = fin.in_latest_quarter(a).where(F.col("county") == "ASIA").groupBy("program_type").agg(fin.money(F.sum("total_budget")).alias("local"))
    out = national.join(local, "program_type", "left").withColumn("local", F.coalesce("local", F.lit(0.0)))
    return out.withColumn("share", fin.percent(F.col("local"), F.nullif("national", F.lit(0.0)), 2))


@register("latest_quarter", VIEWS + "SELECT max_by(quarter, year * 10 + quarter_num) AS quarter FROM activities")
def latest_quarter(spark, d):
    return fin.latest_quarter(activities(spark, d))


@register("latest_quarter_by_label", VIEWS + "SELECT max(quarter) AS quarter FROM activities")
def latest_quarter_by_label(spark, d):
    return fin.lexical_latest_quarter(activities(spark, d))


@register("search_ignoring_case", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%re%' ORDER BY p_name, p_partkey LIMIT 100")
def search_ignoring_case(spark, d):
    return table(spark, d, "part").where(F.col("p_name").ilike("%re%")).select("p_partkey", "p_name", "p_brand").orderBy("p_name", "p_partkey").limit(100)


@register("distinct_quarters", VIEWS + "SELECT quarter, year, quarter_num, dense_rank() OVER (ORDER BY year, quarter_num) AS position FROM (SELECT DISTINCT quarter, year, quarter_num FROM activities)")
def distinct_quarters(spark, d):
    from quern.operators.changes import quarters

    return quarters(activities(spark, d))


@register("category_of_code", "SELECT CASE WHEN p_brand LIKE 'Brand#1%' THEN 'first' WHEN p_brand LIKE 'Brand#12%' THEN 'shadowed' WHEN p_brand LIKE 'Brand#2%' THEN 'second' ELSE 'Other' END AS category, count(*) AS n FROM part GROUP BY 1")
def category_of_code(spark, d):
    category = fin.category_of(F.col("p_brand"), (("Brand#1", "first"), ("Brand#12", "shadowed"), ("Brand#2", "second")))
    return table(spark, d, "part").groupBy(category.alias("category")).agg(fin.count().alias("n"))


@register("subrecipient_funding", VIEWS + "SELECT subrecipient_id, name, org_type, round(sum(allocated), 2) AS allocated, round(sum(expended), 2) AS expended, count(DISTINCT activity_code) AS activities FROM allocations GROUP BY 1, 2, 3")
def subrecipient_funding(spark, d):
    return fin.subrecipient_funding(allocations(spark, d))


@register("types_by_organization", VIEWS + "SELECT org_type, activity_type, count(DISTINCT activity_code) AS activities, round(sum(allocated), 2) AS allocated FROM allocations GROUP BY 1, 2")
def types_by_organization(spark, d):
    return fin.types_by_org(allocations(spark, d))


@register("beneficiaries_by_quarter", VIEWS + "SELECT quarter, sum(households) AS households, count(DISTINCT activity_code) AS activities FROM allocations GROUP BY 1")
def beneficiaries_by_quarter(spark, d):
    return fin.beneficiaries(allocations(spark, d))


@register("beneficiaries_by_type", VIEWS + "SELECT activity_type, sum(households) AS households, count(DISTINCT activity_code) AS activities FROM allocations GROUP BY 1")
def beneficiaries_by_type(spark, d):
    return fin.beneficiaries(allocations(spark, d), "activity_type")


@register(
    "zip_distribution",
    VIEWS
    + """SELECT zip, count(DISTINCT activity_code) AS activities, round(sum(coalesce(funds, 0)), 2) AS funds
FROM (SELECT DISTINCT activity_code, quarter, zip FROM allocations)
LEFT JOIN (SELECT activity_code, quarter, sum(total_budget) AS funds FROM activities WHERE status = 'Completed' GROUP BY 1, 2) USING (activity_code, quarter)
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25""",
)
def zip_distribution(spark, d):
    places = allocations(spark, d).select("activity_code", "quarter", "zip").distinct()
    funds = activities(spark, d).where(fin.is_status("Completed")).groupBy("activity_code", "quarter").agg(F.sum("total_budget").alias("funds"))
    return fin.zip_distribution(places, funds, 25)


@register(
    "sector_completion",
    VIEWS
    + """SELECT org_type, total, completed, underway, expended, coalesce(round(completed * 100.0::DOUBLE / nullif(total, 0), 2), 0) AS completion_rate
FROM (SELECT org_type, count(DISTINCT activity_code) AS total, count(DISTINCT CASE WHEN status = 'Completed' THEN activity_code END) AS completed,
  count(DISTINCT CASE WHEN status = 'Under Way' THEN activity_code END) AS underway, round(sum(expended), 2) AS expended FROM allocations GROUP BY 1)""",
)
def sector_completion(spark, d):
    return fin.sector_completion(allocations(spark, d))


@register("buyout_summary", VIEWS + "SELECT quarter, org_type, count(DISTINCT activity_code) AS activities, round(sum(allocated), 2) AS allocated, sum(households) AS households FROM allocations WHERE is_buyout GROUP BY 1, 2")
def buyout_summary(spark, d):
    return (
        allocations(spark, d).where("is_buyout").groupBy("quarter", "org_type")
        .agg(F.count_distinct("activity_code").cast("bigint").alias("activities"), fin.money(F.sum("allocated")).alias("allocated"), F.sum("households").alias("households"))
    )


@register("quarterly_totals", VIEWS + "SELECT quarter, year, quarter_num, program_type, round(sum(total_budget), 2) AS total_budget, count(*) AS activity_count, count(*) FILTER (status = 'Completed') AS completed_count, count(*) FILTER (status = 'Under Way') AS in_progress_count FROM activities GROUP BY 1, 2, 3, 4")
def quarterly_totals(spark, d):
    return fin.quarterly_totals(activities(spark, d))


@register(
    "funding_hierarchy",
    VIEWS
    + """SELECT 'program' AS kind, program_type AS name, round(sum(total_budget), 2) AS total_budget, count(*) AS activity_count FROM activities GROUP BY 2
UNION ALL SELECT 'organization', responsible_org, round(sum(total_budget), 2), count(*) FROM activities GROUP BY 2
UNION ALL SELECT 'county', county, round(sum(total_budget), 2), count(*) FROM activities GROUP BY 2
UNION ALL SELECT 'total', NULL, round(sum(total_budget), 2), count(*) FROM activities""",
)
def funding_hierarchy(spark, d):
    return fin.hierarchy(activities(spark, d))


@register("expenditure_rates", VIEWS + "SELECT org_type, quarter, round(sum(allocated), 2) AS allocated, round(sum(expended), 2) AS expended, round(sum(expended) / nullif(sum(allocated), 0), 6) AS expenditure_rate FROM allocations GROUP BY 1, 2")
def expenditure_rates(spark, d):
    return fin.expenditure_rates(allocations(spark, d), "org_type", "quarter")
