"""Writers with stable order and headers, and merges by key."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import stages


def to_csv(df: DataFrame, path: str, order: list[str], limit: int = 0) -> None:
    """One CSV file with a header, in order; limit 0 writes all rows. For reports: one task writes."""
    out = df.orderBy(*order)
    (out.limit(limit) if limit else out).coalesce(1).write.mode("overwrite").csv(path, header=True)


def to_json_rows(df: DataFrame) -> DataFrame:
    """Each row as JSON text, nulls kept out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def sidecars(df: DataFrame, path: str, key: str) -> None:
    """The rows of each document as JSON lines in a folder of its own, key=value; rows are dealt by key and a hash of
    the whole row, so that a large document is written by several tasks. A null key has the folder of no value."""
    own = F.pmod(F.xxhash64(*df.columns), F.lit(8))
    df.repartition(F.col(key), own).write.mode("overwrite").partitionBy(key).json(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """old with the rows of new in place of those with the same key; of new's own rows the last one counts."""
    if order:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
        new = new.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those rows of new whose key is not there yet."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def filled(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """old with its nulls filled from new's row of the same key."""
    more = new.dropDuplicates(keys).select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    out = old.join(more, keys, "left")
    return out.withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).select(*old.columns)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def rewritten(new: DataFrame, path: str, document: str, row: list[str], keep: tuple[str, ...] = (), parts: int = 64) -> None:
    """Puts new in place of all rows of its documents in the table at path, and leaves other documents' rows as they are.

    The table lies in `parts` folders by a hash of the document; only the folders of new's documents are written anew.
    Columns of `keep`, such as overrides by hand, stay: a row of the same `row` columns has its old value where new has
    none. A null document is one document. What is written is the same at every run of the same rows, so that a run
    that broke off is repeated as a whole."""
    spark = new.sparkSession
    new = new.withColumn("part", F.pmod(F.xxhash64(document), F.lit(parts)).cast("int"))
    if exists(spark, path):
        old = spark.read.parquet(path)
        same = lambda a, b, cols: functools.reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in cols])
        if keep:
            was = old.where(functools.reduce(lambda x, y: x | y, [F.col(c).isNotNull() for c in keep])).select(*row, *[F.col(c).alias(f"_{c}") for c in keep]).dropDuplicates(row)
            given = new.withColumns({c: F.lit(None).cast(dict(old.dtypes)[c]) for c in keep if c not in new.columns})
            met = given.join(was, same(given, was, row), "left")
            new = met.select(*[(F.coalesce(given[c], was[f"_{c}"]) if c in keep else given[c]).alias(c) for c in given.columns])
        new = stages.cut(new)
        ids, folders = new.select(document).distinct(), new.select("part").distinct()
        others = old.join(F.broadcast(folders), "part", "left_semi")  # at most `parts` rows
        others = others.join(ids, same(others, ids, [document]), "left_anti")
        new = stages.cut(others.unionByName(new, allowMissingColumns=True))
    new.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def pending(docs: DataFrame, ledger: str, document: str, content: list[str]) -> DataFrame:
    """The documents that the ledger does not hold with this content, with a column `version`, a hash of it."""
    docs = docs.withColumn("version", F.sha2(F.to_json(F.struct(*content)), 256))
    if not exists(docs.sparkSession, ledger):
        return docs
    done = docs.sparkSession.read.parquet(ledger).select(F.col(document).alias("_id"), F.col("version").alias("_version")).distinct()
    return docs.join(done, docs[document].eqNullSafe(done["_id"]) & (docs["version"] == done["_version"]), "left_anti")


def processed(docs: DataFrame, path: str, ledger: str, document: str, content: list[str], derive, row: list[str], keep: tuple[str, ...] = (), parts: int = 64) -> int:
    """Derives rows from those documents that are new or changed, rewrites them at path, then enters them in the ledger;
    how many there were. A run between the two steps is repeated to the same end. Also for foreachBatch."""
    new = stages.cut(pending(docs, ledger, document, content))
    n = new.count()
    if n:
        rewritten(derive(new.drop("version")), path, document, row, keep, parts)
        new.select(document, "version").distinct().write.mode("append").parquet(ledger)
    stages.drop(new)
    return n
