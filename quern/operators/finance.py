"""Ledger rollups over activities and allocations.

Amounts stay doubles and are rounded to cents at the output. Rates are null where nothing is divided
by; the order of quarters is chronological, by (year, quarter_num), never by their label.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def money(total: Column) -> Column:
    return F.round(total, 2)


def count() -> Column:
    return F.count(F.lit(1)).cast("bigint")


def is_status(value: str) -> Column:
    return F.col("status") == value


def count_of(value: str) -> Column:
    return F.count_if(is_status(value)).cast("bigint")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(F.try_divide(part * F.lit(100.0), whole), digits)


def filtered(df: DataFrame, **equal) -> DataFrame:
    """Equality predicates on the columns that are given a value; None means no predicate."""
    terms = [F.col(k) == v for k, v in equal.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, terms)) if terms else df


def latest_quarter(df: DataFrame) -> DataFrame:
    """One row: the chronologically last quarter's label."""
    return df.agg(F.max_by("quarter", F.struct("year", "quarter_num")).alias("quarter"))


def lexical_latest_quarter(df: DataFrame) -> DataFrame:
    """One row: the last quarter by label, as text comparison has it."""
    return df.agg(F.max("quarter").alias("quarter"))


def in_latest_quarter(df: DataFrame) -> DataFrame:
    """Rows of the latest quarter: a one-row aggregate is broadcast, in the same job."""
    return df.join(F.broadcast(latest_quarter(df)), "quarter", "left_semi")


def by_program(df: DataFrame) -> DataFrame:
    """Budget and progress of each program."""
    out = df.groupBy("program_type").agg(
        count().alias("activity_count"),
        money(F.sum("total_budget")).alias("total_budget"),
        money(F.sum(F.when(is_status("Completed"), F.col("total_budget")))).alias("completed_budget"),
        count_of("Completed").alias("completed"),
        count_of("Under Way").alias("in_progress"),
    )
    return out.withColumn("completion_rate", F.bround(F.try_divide(F.col("completed") * 100.0, F.col("activity_count")), 1))


def by_place(df: DataFrame, key: str, label: str) -> DataFrame:
    """Budget by a nullable key and program; the raw key groups, and only then does the null get its label.
    A real value that equals the label keeps a row of its own."""
    out = df.groupBy(key, "program_type").agg(count().alias("activity_count"), money(F.sum("total_budget")).alias("allocated"))
    return out.select(F.coalesce(key, F.lit(label)).alias(key), "program_type", "activity_count", "allocated")


def quarterly_trend(df: DataFrame) -> DataFrame:
    return df.groupBy("year", "quarter_num", "quarter", "program_type").agg(
        count().alias("activity_count"), money(F.sum("total_budget")).alias("total_budget"), count_of("Completed").alias("completed")
    )


def completion_rates(df: DataFrame, *keys: str) -> DataFrame:
    """Share of completed rows, rounded half away from zero."""
    return df.groupBy(*keys).agg(count().alias("total"), count_of("Completed").alias("completed"), percent(F.count_if(is_status("Completed")), F.count(F.lit(1))).alias("completion_rate"))


def summary(df: DataFrame) -> DataFrame:
    """One row over everything."""
    return df.agg(
        count().alias("records"),
        F.count_distinct("activity_code").cast("bigint").alias("activities"),
        F.count_distinct("responsible_org").cast("bigint").alias("organizations"),
        F.count_distinct("county").cast("bigint").alias("counties"),
        money(F.sum("total_budget")).alias("total_budget"),
    )


def quarterly_totals(df: DataFrame) -> DataFrame:
    return (
        df.where("quarter is not null and program_type is not null")
        .groupBy("quarter", "year", "quarter_num", "program_type")
        .agg(money(F.sum("total_budget")).alias("total_budget"), count().alias("activity_count"), count_of("Completed").alias("completed_count"), count_of("Under Way").alias("in_progress_count"))
    )


def hierarchy(df: DataFrame) -> DataFrame:
    """Totals by program, organisation, county, and over all, in one pass (grouping sets)."""
    sets = df.groupingSets([["program_type"], ["responsible_org"], ["county"], []], "program_type", "responsible_org", "county")
    out = sets.agg(F.grouping_id().cast("int").alias("level"), money(F.sum("total_budget")).alias("total_budget"), count().alias("activity_count"))
    kind = F.when(F.col("level") == 3, "program").when(F.col("level") == 5, "organization").when(F.col("level") == 6, "county").otherwise("total")
    return out.select(kind.alias("kind"), F.coalesce("program_type", "responsible_org", "county").alias("name"), "total_budget", "activity_count")


def subrecipient_funding(df: DataFrame, org_type: str | None = None) -> DataFrame:
    """Allocated and expended by subrecipient; the rate is null where nothing was allocated."""
    out = filtered(df, org_type=org_type).groupBy("subrecipient_id", "name", "org_type").agg(
        money(F.sum("allocated")).alias("allocated"), money(F.sum("expended")).alias("expended"), F.count_distinct("activity_code").cast("bigint").alias("activities")
    )
    return out


def types_by_org(df: DataFrame) -> DataFrame:
    return df.groupBy("org_type", "activity_type").agg(F.count_distinct("activity_code").cast("bigint").alias("activities"), money(F.sum("allocated")).alias("allocated"))


def beneficiaries(df: DataFrame, by: str = "quarter") -> DataFrame:
    """Households by quarter or by activity type."""
    if by not in ("quarter", "activity_type"):
        raise ValueError(f"group by quarter or activity_type, not {by}")
    return df.groupBy(by).agg(F.sum("households").alias("households"), F.count_distinct("activity_code").cast("bigint").alias("activities"))


def zip_distribution(locations: DataFrame, funds: DataFrame, limit: int) -> DataFrame:
    """Locations left joined with funds of the same activity and quarter: the largest ZIPs."""
    joined = locations.join(funds, ["activity_code", "quarter"], "left")
    out = joined.groupBy("zip").agg(F.count_distinct("activity_code").cast("bigint").alias("activities"), money(F.sum(F.coalesce("funds", F.lit(0.0)))).alias("funds"))
    return out.orderBy(F.desc("activities"), "zip").limit(limit)


def sector_completion(df: DataFrame) -> DataFrame:
    """Distinct activities by status and sector, folded to a rate; 0 where there is none."""
    out = df.groupBy("org_type").agg(
        F.count_distinct("activity_code").cast("bigint").alias("total"),
        F.count_distinct(F.when(is_status("Completed"), F.col("activity_code"))).cast("bigint").alias("completed"),
        F.count_distinct(F.when(is_status("Under Way"), F.col("activity_code"))).cast("bigint").alias("underway"),
        money(F.sum("expended")).alias("expended"),
    )
    return out.withColumn("completion_rate", F.coalesce(percent(F.col("completed"), F.col("total"), 2), F.lit(0.0)))


def expenditure_rates(df: DataFrame, *keys: str) -> DataFrame:
    out = df.groupBy(*keys).agg(F.sum("allocated").alias("a"), F.sum("expended").alias("e"))
    return out.select(*keys, money(F.col("a")).alias("allocated"), money(F.col("e")).alias("expended"), F.round(F.try_divide(F.col("e"), F.col("a")), 6).alias("expenditure_rate"))


#: Activity code prefixes and their categories, in the order in which they are tried. Fixed values.
CATEGORIES = (
    ("ADMIN", "Administration"),
    ("PLANNING", "Planning"),
    ("PLAN", "Planning"),
    ("HAP", "Homeowner Assistance Program"),
    ("HRP", "Homeowner Reimbursement"),
    ("INF", "Infrastructure"),
    ("LBAP", "Local Buyout/Acquisition"),
    ("ERP", "Economic Revitalization"),
    ("ARP", "Affordable Rental"),
    ("PREPS", "PREPS Program"),
    ("Hou", "City of Houston"),
    ("HC", "Harris County"),
    ("HCFCD", "Harris County Flood Control"),
)


def category_of(code: Column, prefixes=CATEGORIES, default: str = "Other") -> Column:
    """The first prefix in order that a code begins with."""
    out = None
    for prefix, name in prefixes:
        out = F.when(code.startswith(prefix), name) if out is None else out.when(code.startswith(prefix), name)
    return out.otherwise(default)


def nested(rows: DataFrame, levels: list[str], value: str) -> DataFrame:
    """One row for each value of the first level: its name, value and the JSON of what lies below it, down to the last
    level: {"name", "value", "children"}, children by name. Sums are made level by level, from
    the leaves up, so a parent holds what its children hold; a missing name is "Unknown", a missing value 0."""
    named = rows.groupBy(*[F.coalesce(F.col(c).cast("string"), F.lit("Unknown")).alias(c) for c in levels]).agg(F.sum(F.coalesce(F.col(value), F.lit(0))).cast("long").alias("value"))
    last = levels[-1]
    node = F.struct(F.col(last).alias("name"), "value")
    for depth in range(len(levels) - 1, 0, -1):
        above = levels[:depth]
        named = named.groupBy(*above).agg(F.sum("value").alias("value"), F.sort_array(F.collect_list(node)).alias("children"))
        node = F.struct(F.col(above[-1]).alias("name"), "value", "children")
    return named.select(F.col(levels[0]).alias("name"), "value", F.to_json(node).alias("json"))
