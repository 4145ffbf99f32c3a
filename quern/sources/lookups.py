"""Look-ups that are kept: each key is asked for once, through a chain of providers, and the answer is cached as JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import stages
from quern.sources.sinks import exists

Provider = Callable[[DataFrame], DataFrame]


def looked_up(wanted: DataFrame, cache: str, providers: list[tuple[str, Provider]], key: str, answer: str) -> tuple[DataFrame, dict[str, int]]:
    """(key and the answer's fields with `provider` for each distinct key of wanted, how many keys each provider was asked).

    A provider gets a frame of keys and gives rows of key and `answer` (a struct type, as DDL fields); of several rows of
    a key the smallest counts, and a row of nulls alone is none. Only keys that the cache at that path does not hold, or
    holds as text that is no such JSON, are asked for; a provider is asked only for what those before it did not know.
    What nobody knows is cached as {} and not asked again; of several entries of a key the newest counts. Null keys have
    no answer. A run that breaks off before its answers are written asks again."""
    spark = wanted.sparkSession
    fields = [x.split()[0] for x in answer.split(", ")]
    shape = answer + ", provider string"
    keys = stages.cut(wanted.select(key).where(F.col(key).isNotNull()).distinct())

    def cached() -> DataFrame:
        newest = spark.read.parquet(cache).groupBy(key).agg(F.max_by("response", F.struct("run", "response")).alias("response"))
        newest = newest.where(F.try_parse_json("response").isNotNull())
        return newest.select(key, F.from_json("response", shape).alias("a"))

    left = keys.join(cached().select(key), key, "left_anti") if exists(spark, cache) else keys
    left = stages.cut(left)
    asked, found = {}, None
    for name, ask in providers:
        asked[name] = left.count()
        if not asked[name]:
            continue
        said = ask(left).join(left, key, "left_semi").where(F.coalesce(*[F.col(c).cast("string") for c in fields]).isNotNull())
        said = stages.cut(said.groupBy(key).agg(F.min(F.struct(*fields)).alias("a")).select(key, *[F.col(f"a.{c}").alias(c) for c in fields], F.lit(name).alias("provider")))
        found = said if found is None else found.unionByName(said)
        left = stages.cut(left.join(said.select(key), key, "left_anti"))
    run = (spark.read.parquet(cache).agg(F.max("run")).first()[0] or 0) + 1 if exists(spark, cache) else 1
    if found is not None:
        new = found.select(key, F.to_json(F.struct(*fields, "provider")).alias("response")).unionByName(left.select(key, F.lit("{}").alias("response")))
        new.withColumn("run", F.lit(run)).write.mode("append").parquet(cache)
    if not exists(spark, cache):
        return keys.select(key, *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in shape.split(", ")]), asked
    return keys.join(cached(), key, "left").select(key, "a.*"), asked
