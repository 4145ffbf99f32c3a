"""Where a loop cuts its lineage: tables written to the shared folder, so lost executors cost no earlier round."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir; below a folder of our own in local mode only, where none is named."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="quern-"))
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """What is written here gives its shuffle files back as soon as the table stands. Otherwise executors keep them until the
    driver's memory happens to be collected, and the more memory it has, the more of a run's shuffles lie on disk at once."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def cut(df: DataFrame, *by: str) -> DataFrame:
    """df, written to the shared folder, in a folder for each value of the columns by, and read back."""
    path = folder(df.sparkSession, "cut")
    with shuffles_released(df.sparkSession):
        df.write.partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def meets(df: DataFrame) -> DataFrame:
    """df as a side of a join that shuffles both: what grows with the input never goes through the driver, however small
    a round leaves it. Loops join dozens of times, and each broadcast would add to what the driver is sent."""
    return df.hint("merge")


def drop(*frames: DataFrame | None) -> None:
    """Deletes tables of cut that nothing reads any more."""
    for df in frames:
        path = getattr(df, "cut_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
