"""Quarter over quarter: positions, changes, deduplication, splitting, pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quarters(df: DataFrame) -> DataFrame:
    """Distinct quarters and their chronological position. A handful of rows, so one window is enough."""
    seen = df.select("quarter", "year", "quarter_num").distinct()
    return seen.withColumn("position", F.dense_rank().over(Window.orderBy("year", "quarter_num")).cast("bigint"))


def last_of_each(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the largest `order` for each key: last write wins."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def period_changes(df: DataFrame, code: str = "activity_code", order: str = "id") -> DataFrame:
    """Budget and status changes of every code between each two consecutive quarters.

    New and removed codes count with a budget of 0 on the missing side; rows without a change of
    either are left out. One full outer join on (code, position).
    """
    one = last_of_each(df, ["quarter", code], order).join(F.broadcast(quarters(df)).select("quarter", "position"), "quarter")
    one = one.select(F.col(code).alias("code"), "quarter", "position", "total_budget", "status")
    old = one.select("code", (F.col("position") + 1).alias("position"), F.col("total_budget").alias("b0"), F.col("status").alias("s0"))
    new = one.select("code", "position", F.col("total_budget").alias("b1"), F.col("status").alias("s1"))
    names = F.broadcast(quarters(df)).select("position", F.col("quarter").alias("to_quarter"))
    before = F.broadcast(quarters(df)).select((F.col("position") + 1).alias("position"), F.col("quarter").alias("from_quarter"))
    both = old.join(new, ["code", "position"], "full_outer").join(names, "position").join(before, "position")
    change = F.round(F.coalesce("b1", F.lit(0.0)) - F.coalesce("b0", F.lit(0.0)), 2)
    kind = F.when(F.col("s0").isNull(), "New").when(F.col("s1").isNull(), "Removed").when(F.col("s0") != F.col("s1"), F.concat("s0", F.lit(" -> "), "s1"))
    out = both.select(F.col("code").alias("activity_code"), "from_quarter", "to_quarter", change.alias("budget_change"), kind.alias("status_change"))
    return out.where("budget_change <> 0 or status_change is not null")


def first_known(df: DataFrame, keys: list[str], order, columns: list[str]) -> DataFrame:
    """One row a key: each column's first value that is not null, in the given order."""
    return df.groupBy(*keys).agg(*[F.min_by(c, F.struct(*order)).alias(c) if c in keys else F.min(F.when(F.col(c).isNotNull(), F.struct(*order, c)))[c].alias(c) for c in columns])


def split_evenly(df: DataFrame, keys: list[str], over: str, value: str) -> DataFrame:
    """Splits a value evenly over the distinct `over` of its keys, then sums by `over`. A null key is a key, a null value
    stays null, and a null `over` gets no share. One shuffle by the keys serves the distinct rows and their number."""
    shares = df.select(*keys, over, value).distinct()
    n = F.size(F.collect_set(over).over(Window.partitionBy(*keys)))
    out = shares.withColumn("_share", F.when(F.col(over).isNotNull(), F.try_divide(F.col(value), n)))
    return out.groupBy(over, *[k for k in keys if k != "activity_code"]).agg(F.round(F.sum("_share"), 2).alias(value), F.count_distinct("activity_code").cast("bigint").alias("activities"))


def total_split_evenly(df: DataFrame, keys: list[str], over: str, value: str, name: str = "total") -> DataFrame:
    """`split_evenly` of the total of each of the keys, in cents: one grouping by keys and `over` gives the parts of the
    totals and the distinct `over` at once, so nothing is joined back and no set is held. Rows with a null key are left out."""
    parts = df.dropna(subset=keys).groupBy(*keys, over).agg(F.sum(value).alias("_part"))
    own = Window.partitionBy(*keys)
    shared = parts.withColumn("_share", F.when(F.col(over).isNotNull(), F.try_divide(F.round(F.sum("_part").over(own), 2), F.count(over).over(own))))
    # a row is a key and an `over`, so an activity is counted once without being told apart
    return shared.groupBy(over, *[k for k in keys if k != "activity_code"]).agg(F.round(F.sum("_share"), 2).alias(name), F.count("activity_code").cast("bigint").alias("activities"))


def pivot_counts(df: DataFrame, key: str, column: str, values: list[str], drop_null_keys: bool = True) -> DataFrame:
    """Counts of each value as columns, 0 where there is none; values are given, so no extra pass finds them."""
    df = df.where(F.col(key).isNotNull()) if drop_null_keys else df
    out = df.groupBy(key).pivot(column, values).agg(F.count(F.lit(1)))
    return out.select(key, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("bigint").alias(v.lower().replace(" ", "_")) for v in values])


def pivot_distinct(df: DataFrame, key: str, column: str, values: list[str], counted: str) -> DataFrame:
    """Distinct counts of each value as columns, in one aggregation."""
    return df.groupBy(key).agg(*[F.count_distinct(F.when(F.col(column) == v, F.col(counted))).cast("bigint").alias(v.lower().replace(" ", "_")) for v in values])


def mode(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key; ties go to the smallest value."""
    n = df.groupBy(key, value).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), value))
    return n.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def missing_from(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the processed ones."""
    return df.join(done, key, "left_anti")
