"""Readers of files: reports' text, CSV and GeoJSON reference data, and catalogue probes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T


def report_files(spark: SparkSession, path: str, pattern: str = "*.txt", without: str | None = None) -> DataFrame:
    """path, category (the folder's name), disaster_code, year, quarter, text of every file below a folder."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    out = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    if without:
        out = out.where(~F.contains("name", F.lit(without)))
    return out.select("path", T.category_of_path(F.col("path")).alias("category"), F.inline(F.array(T.file_facts(F.col("name")))), "text")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header and declared types: codes with leading zeros stay text."""
    return spark.read.csv(path, schema=schema, header=True)


def exploded_codes(df: DataFrame, column: str, into: str) -> DataFrame:
    """A row for each code of a comma list; rows without codes go."""
    return df.withColumn(into, F.explode(F.split(column, ","))).withColumn(into, F.trim(into)).where(F.col(into) != "").drop(column)


def features(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON features: properties as a map, geometry as text."""
    raw = spark.read.schema("features array<struct<properties: map<string, string>, geometry: string>>").json(path, multiLine=True)
    return raw.select(F.inline("features"))


def property_key(found: DataFrame, candidates: list[str]) -> DataFrame:
    """The candidate that most features have; ties to the earlier one. One row, or none."""
    keys = found.select(F.explode(F.map_keys("properties")).alias("key")).where(F.col("key").isin(candidates)).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    place = F.array_position(F.array(*map(F.lit, candidates)), F.col("key"))
    return keys.orderBy(F.desc("n"), place).limit(1).select("key")


def with_text(pages: DataFrame, least: int = 100) -> DataFrame:
    """Documents whose pages hold enough text that no character recognition is called for."""
    return pages.groupBy("document_id").agg(F.sum(F.length("text_content")).alias("n_chars")).where(F.coalesce("n_chars", F.lit(0)) >= least)


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """name, rows of several tables, counted in one job."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(k).alias("name"), "rows") for k, df in tables.items()])
