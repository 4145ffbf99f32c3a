"""Registered panels, places, events and catalogue queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import spatial
from quern.operators.changes import mode
from quern.operators.finance import money
from quern.registry import register
from quern.sources.tables import VIEWS, activities, table


def n():
    return F.count(F.lit(1)).cast("bigint")


@register(
    "panel_document",
    """SELECT doc_id, lang, source, length(text) AS n_chars, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, quality, toxic, coalesce(hits, 0) AS benchmark_twins
FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id)
LEFT JOIN (SELECT text, count(*) AS hits FROM documents GROUP BY 1 HAVING count(*) > 1) USING (text)""",
)
def panel_document(spark, d):
    docs = table(spark, d, "documents")
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    twins = docs.groupBy("text").agg(n().alias("hits")).where("hits > 1")
    full = docs.select("doc_id", "lang", "source", "text").join(labels, "doc_id", "left").join(twins, "text", "left")
    return full.select("doc_id", "lang", "source", F.length("text").cast("bigint").alias("n_chars"), F.size(F.split("text", "\n", -1)).cast("bigint").alias("n_lines"), "quality", "toxic", F.coalesce("hits", F.lit(0)).alias("benchmark_twins"))


@register("panel_quarter", VIEWS + "SELECT year, quarter_num, count(*) AS activities, count(DISTINCT activity_code) AS codes, count(DISTINCT responsible_org) AS organizations, round(sum(total_budget), 2) AS budget, round(max(total_budget), 2) AS largest, round(avg(total_budget), 4) AS average, count(*) FILTER (status = 'Completed') AS completed FROM activities GROUP BY 1, 2")
def panel_quarter(spark, d):
    return activities(spark, d).groupBy("year", "quarter_num").agg(
        n().alias("activities"), F.count_distinct("activity_code").cast("bigint").alias("codes"), F.count_distinct("responsible_org").cast("bigint").alias("organizations"), money(F.sum("total_budget")).alias("budget"),
        money(F.max("total_budget")).alias("largest"), F.round(F.avg("total_budget"), 4).alias("average"), F.count_if(F.col("status") == "Completed").cast("bigint").alias("completed"),
    )


@register("panel_county", VIEWS + "SELECT county, year, quarter_num, count(*) AS activities, round(sum(total_budget), 2) AS budget, count(*) FILTER (status = 'Completed') AS completed, count(*) FILTER (status = 'Under Way') AS under_way, round_even(count(*) FILTER (status = 'Completed')::DOUBLE / count(*), 4) AS completion_rate FROM activities WHERE county IS NOT NULL GROUP BY 1, 2, 3")
def panel_county(spark, d):
    done = F.count_if(F.col("status") == "Completed")
    return activities(spark, d).where("county is not null").groupBy("county", "year", "quarter_num").agg(
        n().alias("activities"), money(F.sum("total_budget")).alias("budget"), done.cast("bigint").alias("completed"), F.count_if(F.col("status") == "Under Way").cast("bigint").alias("under_way"),
        F.bround(done.cast("double") / F.count(F.lit(1)), 4).alias("completion_rate"),
    )


@register("share_of_quarter", VIEWS + "SELECT quarter, program_type, budget, round(budget * 100 / nullif(sum(budget) OVER (PARTITION BY quarter), 0), 4) AS share FROM (SELECT quarter, program_type, round(sum(total_budget), 2) AS budget FROM activities GROUP BY 1, 2)")
def share_of_quarter(spark, d):
    by = activities(spark, d).groupBy("quarter", "program_type").agg(money(F.sum("total_budget")).alias("budget"))
    return by.withColumn("share", F.round(F.try_divide(F.col("budget") * 100, F.sum("budget").over(Window.partitionBy("quarter"))), 4))


@register("event_property_severity", "SELECT event_type, count(*) AS events, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS severity, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def event_property_severity(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, d, "events").groupBy("event_type").agg(n().alias("events"), F.max(k).alias("severity"), F.count_distinct("user_id").cast("bigint").alias("users"))


@register("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS starts, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    from quern.streaming.rollups import tumbling

    return tumbling(table(spark, d, "events"), "1 hour")


@register(
    "event_sessions",
    """WITH e AS (SELECT user_id, ts, (lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE)::INT AS f FROM events),
g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id, min(ts) AS starts, count(*) AS events FROM g GROUP BY user_id, g""",
)
def event_sessions(spark, d):
    from quern.streaming.rollups import sessions

    return sessions(table(spark, d, "events"), "30 minutes")


@register("carried_values", "SELECT event_id, user_id, last_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS known FROM events")
def carried_values(spark, d):
    some = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    return spatial.carried(some, ["user_id"], "event_id", "v", "known").select("event_id", "user_id", "known")


@register("type_of_user", "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def type_of_user(spark, d):
    return mode(table(spark, d, "events"), "user_id", "event_type")


@register("zip_ranges", "SELECT p_partkey, unnest(range(77000 + p_partkey % 50, 77001 + p_partkey % 50 + p_partkey % 7))::VARCHAR AS zip FROM part")
def zip_ranges(spark, d):
    low = F.lit(77000) + F.col("p_partkey") % 50
    text = F.concat(F.lit("Zip Codes "), low, F.lit(" - "), low + F.col("p_partkey") % 7)
    return table(spark, d, "part").select("p_partkey", F.explode(T.zip_codes(text)).alias("zip"))


@register("tract_ids", "SELECT p_partkey, '48201' || lpad(CAST(p_partkey % 9000 AS VARCHAR), 4, '0') || rpad(CAST(p_partkey % 90 AS VARCHAR), 2, '0') AS geoid FROM part")
def tract_ids(spark, d):
    written = F.concat((F.col("p_partkey") % 9000).cast("string"), F.lit("."), (F.col("p_partkey") % 90).cast("string"))
    return table(spark, d, "part").select("p_partkey", T.geoid(F.lit("201"), written).alias("geoid"))


@register("spatial_units", "SELECT n_nationkey, 'zip' AS unit_type, CAST(77000 + n_nationkey AS VARCHAR) AS unit_value FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, 'city', n_name || ', TX' FROM nation UNION ALL SELECT n_nationkey, 'county', r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_nationkey, 'tract', r_name || '|tract:' || n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def spatial_units(spark, d):
    r = table(spark, d, "region")
    m = table(spark, d, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.when(F.col("n_nationkey") % 2 == 0, (F.lit(77000) + F.col("n_nationkey")).cast("string")).alias("zip"),
        F.col("n_name").alias("city"), F.col("r_name").alias("county"), F.col("n_nationkey").cast("string").alias("tract"), F.lit("TX").alias("state"),
    )
    return spatial.units(m, ("n_nationkey",))


@register("table_rows", "SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS row_index, n_nationkey || ' Main St' AS address, n_name AS city FROM nation")
def table_rows(spark, d):
    """JSON tables are written, one a region, and their rows are read back by the roles of their headers."""
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    cells = F.transform(rows, lambda x: F.array(F.concat(x["n_nationkey"], F.lit(" Main St")), x["n_name"]))
    grid = F.to_json(F.concat(F.array(F.array(F.lit("Address"), F.lit("City "))), cells))
    tables = table(spark, d, "nation").groupBy("n_regionkey").agg(grid.alias("table_data"))
    return spatial.table_rows(tables, keep=("n_regionkey",)).select("n_regionkey", "row_index", "address", "city")


@register("points_in_box", "SELECT c_custkey, floor(lat * 20)::BIGINT || '_' || floor(lon * 20)::BIGINT AS cell FROM (SELECT c_custkey, 20 + c_custkey % 20 AS lat, -(90 + c_custkey % 25) AS lon FROM customer) WHERE lat BETWEEN 24 AND 37 AND lon BETWEEN -107 AND -93")
def points_in_box(spark, d):
    lat, lon = (F.lit(20) + F.col("c_custkey") % 20).cast("double"), (F.lit(90) + F.col("c_custkey") % 25).cast("double")
    return table(spark, d, "customer").where(spatial.in_texas(lat, lon)).select("c_custkey", spatial.grid_cell(lat, -lon).alias("cell"))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@register("table_manifest", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in TABLES))
def table_manifest(spark, d):
    from functools import reduce

    counts = [table(spark, d, t).agg(n().alias("rows")).select(F.lit(t).alias("name"), "rows") for t in TABLES]
    return reduce(lambda a, b: a.unionByName(b), counts)


@register("file_facts", "SELECT o_orderkey, 'h5b' AS disaster_code, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter FROM orders")
def file_facts(spark, d):
    y, q = F.year("o_orderdate").cast("string"), F.quarter("o_orderdate").cast("string")
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("drgr-h5b-"), y, F.lit("-q"), q, F.lit(".pdf"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("h5b-"), y, F.lit("-"), q, F.lit("q.pdf"))).otherwise(F.concat(F.lit("h5b_q"), q, F.lit("-"), y, F.lit(".pdf")))
    return table(spark, d, "orders").select("o_orderkey", F.inline(F.array(T.file_facts(name))))
