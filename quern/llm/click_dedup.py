"""Clicks that repeat, within windows that expire by punctuation: no watermark and no timer.

Copies of the clicks are cut into batches and fed in order to one stateful query, started anew for each batch on one
checkpoint. Beside its rows a batch has one control row for each bucket, which carries the batch's number and M, the
largest hour so far. A bucket folds its data into open windows first; then the control row has the windows scanned, in
a MapState by start day, and those closed that M has left behind.

A bucket is a hash of the click_id, so its rows of a batch are about `bucket_rows`. Rows of one click, hour and hash are
counted before they are dealt. A click with more than `split_rows` such rows is split over several buckets by its
hashes: each of them gets the click's outline (the least hash of each hour, counted as no row), from which all find the
same windows, and their counts are added up at the end.

A null click_id or arrived_at, or a negative click_id, makes no copies. A value that is null or not finite is empty in
the hash. Rows that repeat as a whole count each; an empty table gives no windows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from quern.llm.common import gather, release, scratch, width

BATCHES, KEEP, LATE = 8, 24, 96
#: Rows of a batch in one bucket, and rows of one click from which it is split over several buckets.
BUCKET_ROWS, SPLIT_ROWS = 50_000, 100_000

FED = "click_id long, hour long, hash binary, n long, bucket long, batch int, m long"
CLOSED = "click_id long, start_hour long, closed_batch long, n long, n_conflicts long, conflict_crc long, hash binary"
#: An open window; its hash as four numbers that order as its bytes do, and n with the opener's own row.
WINDOW = np.dtype([("click", "<i8"), ("start", "<i8"), ("n", "<i8"), ("conflicts", "<i8"), ("crc", "<i8"), ("hash", "<u8", 4)])
#: M of the last control row: whatever is open ends.
END = 1 << 60

SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # all stores of an executor share one cache and its write buffers, however many partitions it has
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # each start has one batch: its stores are not kept open after it
}


def _micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970; a time without a zone is read as UTC, whatever the session's zone."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.expr(f"unix_date(date({name})) * 86400000000L + hour({name}) * 3600000000L + minute({name}) * 60000000L + bigint(extract(SECOND FROM {name}) * 1000000)")
    return F.unix_micros(name)


def copies(clicks: DataFrame) -> DataFrame:
    """(click_id, hour, at, hash): each row's copies; at is the hour of delivery."""
    us = _micros(clicks, "arrived_at")
    cents = F.when(~F.isnan("value") & (F.abs("value") < 1e16), F.floor(100 * F.col("value") + 0.5))
    parts = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")) for c in ("client_id", "kind", cents, _micros(clicks, "ts"), "props")]
    rows = clicks.where("click_id >= 0 AND arrived_at IS NOT NULL").select(
        "click_id", F.expr("explode(sequence(0L, click_id % 3))").alias("j"), ((us - F.pmod(us, F.lit(3_600_000_000))) / 3_600_000_000).cast("long").alias("hour"), F.concat_ws("|", *parts).alias("payload")
    )
    rows = rows.withColumn("c", F.crc32(F.concat_ws(":", F.col("click_id").cast("string"), F.col("j").cast("string")).cast("binary")))
    rows = rows.withColumn("hour", F.expr("hour + 6 * j * (c % 10)"))
    return rows.select("click_id", "hour", F.expr("hour + (c div 10) % 200").alias("at"), F.unhex(F.sha2(F.concat_ws("|", "payload", F.expr("string(c % 3)")).cast("binary"), 256)).alias("hash"))


def in_batches(events: DataFrame, batches: int) -> DataFrame | None:
    """Events counted by (batch, click_id, hour, hash); None if there are none."""
    low, high = events.agg(F.min("at"), F.max("at")).first()
    if low is None:
        return None
    batch = F.expr(f"int((at - {low}L) * {batches} div {high - low + 1}L)")
    return events.groupBy(batch.alias("batch"), "click_id", "hour", "hash").agg(F.count("*").alias("n"))


def _split(counted: DataFrame, hot: DataFrame, buckets: int, split_rows: int) -> DataFrame:
    """counted with a bucket for the rows of hot clicks, and those clicks' outlines in each of their buckets."""
    home = F.pmod(F.xxhash64("click_id"), F.lit(buckets))
    parts = hot.select("click_id", F.least(F.lit(buckets), F.ceil(F.col("rows") / split_rows)).alias("parts"))
    both = counted.join(parts, "click_id", "left")
    own = both.withColumn("bucket", F.when(F.col("parts").isNotNull(), F.pmod(home + F.pmod(F.xxhash64("hash"), F.col("parts")), F.lit(buckets)))).drop("parts")
    outline = counted.join(parts, "click_id").groupBy("batch", "click_id", "hour", "parts").agg(F.min("hash").alias("hash"))
    outline = outline.withColumn("bucket", F.expr(f"explode(transform(sequence(0L, parts - 1), p -> pmod(pmod(xxhash64(click_id), {buckets}L) + p, {buckets}L)))"))
    return own.unionByName(outline.select(*[c for c in own.columns if c != "n"], F.lit(0).cast("long").alias("n")))


def fold(rows: dict[str, np.ndarray], windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(still open, closed) when rows meet the open windows, at most one a click. rows: click, hour, hash (n x 4), n, crc."""
    order = np.lexsort((*(rows["hash"][:, i] for i in (3, 2, 1, 0)), rows["hour"], rows["click"]))
    click, hour, hashes, n, crc = (rows[k][order] for k in ("click", "hour", "hash", "n", "crc"))
    clicks, first, sizes = np.unique(click, return_index=True, return_counts=True)
    end = first + sizes
    now = np.zeros(len(clicks), WINDOW)
    at, known = first.copy(), np.zeros(len(clicks), bool)
    if len(windows):
        windows = windows[np.argsort(windows["click"], kind="stable")]
        place = np.minimum(np.searchsorted(windows["click"], clicks), len(windows) - 1)
        known = windows["click"][place] == clicks
        now[known] = windows[place[known]]
        windows = np.delete(windows, place[known])
    low = hour.min()
    span = int(hour.max() - low) + 2
    line = np.repeat(np.arange(len(clicks)), sizes) * span + (hour - low)  # ascends over all rows
    total = np.concatenate([[0], np.cumsum(n)])
    closed = []
    live = np.arange(len(clicks))
    while len(live):
        new = live[~known[live]]
        now["click"][new], now["start"][new], now["hash"][new] = clicks[new], hour[at[new]], hashes[at[new]]
        for k in ("n", "conflicts", "crc"):
            now[k][new] = 0
        last = np.clip(now["start"][live] + KEEP - low, -1, span - 2)
        to = np.maximum(at[live], np.minimum(np.searchsorted(line, live * span + last, "right"), end[live]))
        count = to - at[live]
        now["n"][live] += total[to] - total[at[live]]
        taken, of = gather(at[live], count), np.repeat(live, count)
        other = (hashes[taken] != now["hash"][of]).any(axis=1)
        np.add.at(now["conflicts"], of[other], n[taken[other]])
        np.add.at(now["crc"], of[other], n[taken[other]] * crc[taken[other]])
        at[live] = to
        live = live[to < end[live]]
        closed.append(now[live])
        known[live] = False
    return np.concatenate([windows, now]), np.concatenate(closed) if closed else now[:0]


def _table(windows: np.ndarray, batch: int) -> Iterator[pd.DataFrame]:
    for i in range(0, len(windows), 20_000):
        w = windows[i : i + 20_000]
        raw = w["hash"].astype(">u8").tobytes()
        yield pd.DataFrame(
            {"click_id": w["click"], "start_hour": w["start"], "closed_batch": np.full(len(w), batch), "n": w["n"], "n_conflicts": w["conflicts"], "conflict_crc": w["crc"], "hash": [raw[j : j + 32] for j in range(0, len(raw), 32)]}
        )


class Punctuated(StatefulProcessor):
    """One bucket: its open windows by the day of their start, and M of the last control row."""

    def init(self, handle) -> None:
        self.open = handle.getMapState("open", "day long", "windows binary")
        self.last = handle.getValueState("last", "m long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        parts, control = [], None
        for pdf in rows:
            told = pdf["batch"].to_numpy() >= 0
            if told.any():
                control = pdf[told].iloc[0]
            data = pdf[~told]
            if len(data):
                hashes = np.frombuffer(b"".join(data["hash"]), ">u8").astype("<u8").reshape(-1, 4)
                parts.append({"click": data["click_id"].to_numpy(np.int64), "hour": data["hour"].to_numpy(np.int64), "hash": hashes, "n": data["n"].to_numpy(np.int64), "crc": data["crc"].to_numpy(np.int64)})
        batch, m = int(control["batch"]), int(control["m"])
        before = {k[0]: v[0] for k, v in self.open.iterator()}
        windows = np.frombuffer(b"".join(before.values()), WINDOW)
        if parts:
            data = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            if self.last.exists():
                keep = data["hour"] >= self.last.get()[0] - LATE
                data = {k: v[keep] for k, v in data.items()}
            if len(data["click"]):
                windows, closed = fold(data, windows)
                yield from _table(closed, batch)
        gone = windows["start"] + KEEP < m - LATE
        yield from _table(windows[gone], batch)
        windows = windows[~gone]
        self.last.update((m,))
        days = windows["start"] // 24
        after = {int(d): windows[days == d].tobytes() for d in np.unique(days)}
        for d in before.keys() - after.keys():
            self.open.removeKey((d,))
        for d, raw in after.items():
            if before.get(d) != raw:
                self.open.updateValue((d,), (raw,))

    def close(self) -> None:
        pass


def _moved(spark: SparkSession, path: str, to: str) -> None:
    """A folder gets its final name, so that the stream sees a batch when it is complete."""
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(jvm.Path(to).getParent())
    if not fs.rename(jvm.Path(path), jvm.Path(to)):
        raise OSError(f"{path} can't be renamed to {to}")


def _started(spark: SparkSession, feed: str, out: str, checkpoint: str, buckets: int) -> None:
    """The stateful query over what the feed has got since its last start."""
    rows = spark.readStream.schema(FED).parquet(f"{feed}/*")
    bucket = F.coalesce("bucket", F.pmod(F.xxhash64("click_id"), F.lit(buckets)))
    rows = rows.select(bucket.alias("bucket"), "click_id", "hour", "hash", "n", F.crc32(F.lower(F.hex("hash")).cast("binary")).alias("crc"), F.coalesce("batch", F.lit(-1)).alias("batch"), "m")
    windows = rows.groupBy("bucket").transformWithStateInPandas(Punctuated(), CLOSED, "Append", "None")
    stream = windows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    stream.awaitTermination()


def with_settings(run):
    """run, with SETTINGS in its session while it lasts."""

    @functools.wraps(run)
    def inner(spark: SparkSession, *a, **b):
        before = {k: spark.conf.get(k, None) for k in SETTINGS}
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        try:
            return run(spark, *a, **b)
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    return inner


@with_settings
def _streamed(spark: SparkSession, counted: str, folder: str, largest: list[int], buckets: int) -> DataFrame:
    for b, m in enumerate(largest):
        control = spark.range(buckets).select(F.lit(0).cast("long").alias("click_id"), F.lit(0).cast("long").alias("hour"), F.lit(b"").alias("hash"), F.lit(0).cast("long").alias("n"), F.col("id").alias("bucket"), F.lit(b).alias("batch"), F.lit(m).cast("long").alias("m"))
        control.coalesce(1).write.mode("append").parquet(f"{counted}/fed={b}")
        _moved(spark, f"{counted}/fed={b}", f"{folder}/feed/{b}")
        _started(spark, f"{folder}/feed", f"{folder}/closed", f"{folder}/checkpoint", buckets)
    return spark.read.schema(CLOSED).parquet(f"{folder}/closed")


def windows(clicks: DataFrame, batches: int = BATCHES, bucket_rows: int = BUCKET_ROWS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Every window of every click: click_id, start_hour, closed_batch, n_repeats, n_conflicts, conflict_crc, hash."""
    spark = clicks.sparkSession
    counted = in_batches(copies(clicks), batches)
    if counted is None:
        return _report(spark.createDataFrame([], CLOSED), False)
    folder = scratch(spark, "clicks")
    counted.withColumn("fed", F.col("batch")).drop("batch").write.partitionBy("fed").parquet(f"{folder}/counted")
    table = spark.read.parquet(f"{folder}/counted")
    largest = dict(table.groupBy("fed").agg(F.max("hour")).collect())  # at most `batches` rows
    rows = table.count()
    buckets = max(4 * width(spark), math.ceil(rows / batches / bucket_rows))
    hot = table.groupBy("click_id").agg(F.count("*").alias("rows")).where(F.col("rows") > split_rows)
    at, split = f"{folder}/counted", bool(hot.limit(1).count())
    if split:
        at = f"{folder}/split"
        _split(table.withColumnRenamed("fed", "batch"), hot, buckets, split_rows).withColumnRenamed("batch", "fed").write.partitionBy("fed").parquet(at)
        release(table)
    most, told = None, []
    for b in range(batches):
        most = max((x for x in (most, largest.get(b)) if x is not None), default=None)
        told.append(END if b == batches - 1 else most)
    return _report(_streamed(spark, at, folder, told, buckets), split)


def _report(closed: DataFrame, split: bool) -> DataFrame:
    if split:
        closed = closed.groupBy("click_id", "start_hour", "closed_batch", "hash").agg(*(F.sum(c).alias(c) for c in ("n", "n_conflicts", "conflict_crc")))
    return closed.select("click_id", "start_hour", "closed_batch", (F.col("n") - 1).alias("n_repeats"), "n_conflicts", "conflict_crc", F.lower(F.hex("hash")).alias("hash"))
