"""Funding flows as node and link tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def links(df: DataFrame, levels: list[str], value: str, sources: tuple[str, ...] = ("HUD", "GLO")) -> DataFrame:
    """Links of a Sankey: fixed sources first, then one column after the other; equal links add up, only
    positive ones stay. A name that occurs on two levels is told apart by its level."""
    top = df.agg(F.lit(0).alias("level"), F.lit(sources[0]).alias("source"), F.lit(sources[1]).alias("target"), F.sum(value).alias("amount"))
    parts = [top]
    before = F.lit(sources[1])
    for k, name in enumerate(levels, 1):
        parts.append(df.groupBy(F.lit(k).alias("level"), before.alias("source"), F.coalesce(F.col(name), F.lit("Unknown")).alias("target")).agg(F.sum(value).alias("amount")))
        before = F.coalesce(F.col(name), F.lit("Unknown"))
    out = reduce(DataFrame.unionByName, parts)
    return out.select("level", "source", "target", F.round("amount", 2).alias("amount")).where("amount > 0")


def nodes(flow: DataFrame) -> DataFrame:
    """Nodes of a link table with what flows in and out."""
    ends = flow.select(F.col("source").alias("node"), F.col("level"), F.col("amount").alias("outflow"), F.lit(0.0).alias("inflow")).unionByName(
        flow.select(F.col("target").alias("node"), (F.col("level") + 1).alias("level"), F.lit(0.0).alias("outflow"), F.col("amount").alias("inflow"))
    )
    return ends.groupBy("node", "level").agg(F.round(F.sum("inflow"), 2).alias("inflow"), F.round(F.sum("outflow"), 2).alias("outflow"))
