"""Tables of a data folder, and the report model's views over them.

Each view has the same definition twice: as a DataFrame, and as the SQL (VIEWS) that a query's oracle
starts from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grant activities, one row an order: quarter, program, organisation, county, status, budget."""
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    customer = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    joined = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    year, quarter = F.year("o_orderdate"), F.quarter("o_orderdate")
    return joined.select(
        F.col("o_orderkey").alias("id"),
        year.cast("bigint").alias("year"),
        quarter.cast("bigint").alias("quarter_num"),
        F.concat(F.lit("Q"), quarter, F.lit(" "), year).alias("quarter"),
        F.col("c_mktsegment").alias("program_type"),
        F.when(F.col("n_nationkey") != 3, F.col("n_name")).alias("responsible_org"),
        F.when(F.col("n_nationkey") % 7 != 2, F.col("r_name")).alias("county"),
        F.concat(F.lit("ACT-"), F.col("o_custkey")).alias("activity_code"),
        F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", "Under Way").otherwise("Cancelled").alias("status"),
        F.col("o_totalprice").alias("total_budget"),
        F.col("o_orderpriority").alias("activity_type"),
    )


def allocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allocations to subrecipients, one row a line item."""
    orders = table(spark, sf_dir, "orders")
    supplier = table(spark, sf_dir, "supplier")
    joined = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    kind = F.element_at(F.array(*map(F.lit, ("government", "nonprofit", "private", "quasi-governmental"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return joined.select(
        F.col("l_suppkey").alias("subrecipient_id"),
        F.col("s_name").alias("name"),
        kind.alias("org_type"),
        F.concat(F.lit("ACT-"), F.col("o_custkey")).alias("activity_code"),
        F.concat(F.lit("Q"), F.quarter("o_orderdate"), F.lit(" "), F.year("o_orderdate")).alias("quarter"),
        F.year("o_orderdate").cast("bigint").alias("year"),
        F.quarter("o_orderdate").cast("bigint").alias("quarter_num"),
        F.col("l_extendedprice").alias("allocated"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("expended"),
        F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", "Under Way").otherwise("Cancelled").alias("status"),
        (F.lit(77000) + F.col("l_partkey") % 100).cast("string").alias("zip"),
        F.col("l_quantity").alias("households"),
        F.col("o_orderpriority").alias("activity_type"),
        (F.col("l_partkey") % 5 == 0).alias("is_buyout"),
    )


VIEWS = """
WITH activities AS (
  SELECT o_orderkey AS id, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(quarter(o_orderdate) AS BIGINT) AS quarter_num,
         'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) AS quarter, c_mktsegment AS program_type,
         CASE WHEN n_nationkey <> 3 THEN n_name END AS responsible_org,
         CASE WHEN n_nationkey % 7 <> 2 THEN r_name END AS county, 'ACT-' || o_custkey AS activity_code,
         CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Under Way' ELSE 'Cancelled' END AS status,
         o_totalprice AS total_budget, o_orderpriority AS activity_type
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
allocations AS (
  SELECT l_suppkey AS subrecipient_id, s_name AS name,
         CASE s_suppkey % 4 WHEN 0 THEN 'government' WHEN 1 THEN 'nonprofit' WHEN 2 THEN 'private' ELSE 'quasi-governmental' END AS org_type,
         'ACT-' || o_custkey AS activity_code, 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) AS quarter,
         CAST(year(o_orderdate) AS BIGINT) AS year, CAST(quarter(o_orderdate) AS BIGINT) AS quarter_num,
         l_extendedprice AS allocated, l_extendedprice * (1 - l_discount) AS expended,
         CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Under Way' ELSE 'Cancelled' END AS status,
         CAST(77000 + l_partkey % 100 AS VARCHAR) AS zip, l_quantity AS households, o_orderpriority AS activity_type,
         l_partkey % 5 = 0 AS is_buyout
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)
"""
