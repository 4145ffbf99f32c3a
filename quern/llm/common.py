"""What the operators of this subpackage share: scratch tables, words, hashes, buckets, components.

Every intermediate table goes to the shared folder named by ``spark.checkpoint.dir``; nothing is
kept in a machine-local folder unless the session runs in local mode and names no such folder.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.stages import shuffles_released

#: ASCII letters folded to lower case; bytes.split() then cuts at [\x20\x09-\x0D], as the contracts want.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: As LOWER, and every ASCII byte but letters and digits becomes a space.
ALNUM = bytes(LOWER[c] if c > 127 or chr(c).isalnum() else 32 for c in range(256))

#: Most rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

_own: dict[str, str] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the cluster's shared folder; below a folder of our own in local mode only."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="quern-")
        base = _own[app]
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, label)
    with shuffles_released(df.sparkSession):
        df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches have at most BATCH_ROWS rows and BATCH_BYTES bytes: what a task and its
    Python worker hold at once does not grow with the length of texts."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def lean(run):
    """run, and what its task leaves behind is given back: a Python worker stays for the tasks of other operators."""

    def own(batches):
        yield from run(batches)
        _give_back()

    return own


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def release(*frames: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions; key spaces are cut in proportion to it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class WordHash(dict):
    """64-bit hash of a word; forgets its words when they are too many, so memory is bounded."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, n: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of all runs of n consecutive word hashes; the caller masks runs that cross documents."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    k = np.uint64(seed | 1)
    out, m, have = mix(h ^ k), 1, {1: mix(h ^ k)}
    while m * 2 <= n:  # doubling: a run of 2m is two runs of m
        out = mix(out[: len(out) - m] * k + out[m:])
        m *= 2
        have[m] = out
    while m < n:
        p = max(q for q in have if q <= n - m)
        out = mix(out[: len(h) - m - p + 1] * k + have[p][m : m + len(h) - m - p + 1])
        m += p
    return out


def texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column; nulls stay None."""
    return column.cast(pa.large_binary()).to_pylist()


def gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + count)."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts - starts, counts)


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """(key, blobs) of each key of two-column batches that come sorted by the first column."""
    now, blobs = None, []
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        values = batch.column(1).to_pylist()
        for k, v in zip(keys.tolist(), values, strict=True):
            if k != now:
                if blobs:
                    yield now, blobs
                now, blobs = k, []
            blobs.append(v)
    if blobs:
        yield now, blobs


def rows_by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(key, rows of the other columns) of each key of batches that come sorted by the first column."""
    now, rows = None, []
    for batch in batches:
        for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != now:
                if rows:
                    yield now, rows
                now, rows = k, []
            rows.append(tuple(row))
    if rows:
        yield now, rows


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows with equal keys in one partition, in key order there; as many keys in each as in any other."""
    n = width(df.sparkSession)
    return df.repartitionById(n, F.pmod(F.col(key), F.lit(n)).cast("int")).sortWithinPartitions(key)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that is reachable, for undirected edges (a, b) of longs.

    Minimum labels spread along edges and along the labels themselves (pointer jumping), a few
    rounds for any usual graph; each round is a written table. Ids without an edge are absent.
    """
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        step = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "m").alias("new"))
        step = stage(step, "labels")
        up = step.select(F.col("id").alias("new"), F.col("new").alias("next"))
        nxt = stage(step.join(up, "new", "left").select("id", F.least("new", F.coalesce("next", "new")).alias("component"), "old"), "labels")
        changed = nxt.where("component <> old").limit(1).count()
        release(labels, step)
        labels = nxt.select("id", "component")
        if not changed:
            release(both)
            return labels
