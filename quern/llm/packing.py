"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded.

A document of L ids is cut into floor(L / 2048) pieces of 2048 ids, then one piece for every binary
digit of the rest, longest first. Each piece is a sequence of its own whose length is a power of
two; pieces of one length form a bucket, from which a trainer draws batches of equal shape. A
sequence's number is dense: all of the longest bucket first, and inside a bucket in document order.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import bounded, lean, release, stage, width
from quern.llm.tokens import codec, default_vocabulary, forget, runs

SEQUENCE = 2048


def pieces_of(length: int, sequence: int = SEQUENCE) -> list[int]:
    """Lengths of a document's pieces, in order: whole sequences, then falling powers of two."""
    rest = length % sequence
    return [sequence] * (length // sequence) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _cut(vocabulary: str, sequence: int, with_ids: bool):
    def run(batches):
        words = codec(vocabulary)
        encode = words.encode
        for batch in batches:
            column, keys = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in runs(column):
                ids, n = encode(column.slice(lo, hi - lo))
                out, at = [], 0
                for key, m in zip(keys[lo:hi], n.tolist(), strict=True):
                    raw, start, crcs, own = memoryview(ids[at : at + m].astype("<u4").tobytes()), 0, [], []
                    for length in pieces_of(m, sequence):
                        part = raw[4 * start : 4 * (start + length)]
                        crcs.append(zlib.crc32(part))
                        own.append(bytes(part) if with_ids else None)
                        start += length
                    at += m
                    out.append((key, m, crcs, own if with_ids else None))
                k, m, c, o = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(m, pa.int64()), pa.array(c, pa.list_(pa.int64())), pa.array(o, pa.list_(pa.binary()))], ["doc_id", "doc_tokens", "crcs", "pieces"])
        forget(words)

    return run


def numbered_files(df: DataFrame, sums: list[str], key: str) -> DataFrame:
    """Adds `<c>_before` for each column c in sums: its sum over all rows of smaller key.

    df is dealt out by ranges of the key and written, so each file is a range; only one row a file
    goes to the driver. Inside a file a window adds up.
    """
    spark = df.sparkSession
    parts = stage(df.repartitionByRange(width(spark), F.col(key).asc_nulls_first(), *[c for c in df.columns if c != key and dict(df.dtypes)[c] == "bigint"]).sortWithinPartitions(F.col(key).asc_nulls_first()), "ranges")
    parts = parts.withColumn("_file", F.col("_metadata.file_name"))
    totals = parts.groupBy("_file").agg(F.min(F.struct(F.col(key).isNotNull(), key)).alias("least"), F.max(F.struct(F.col(key).isNotNull(), key)).alias("most"), *[F.sum(c).alias(c) for c in sums])
    before = dict.fromkeys(sums, 0)
    rows = []
    for r in sorted(totals.collect(), key=lambda r: tuple((x[0], x[1] or 0) for x in (r["least"], r["most"]))):
        rows.append((r["_file"], *(before[c] for c in sums)))
        for c in sums:
            before[c] += r[c]
    base = spark.createDataFrame(rows, ", ".join(["_file string", *(f"`{c}_base` long" for c in sums)]))
    order = Window.partitionBy("_file").orderBy(F.col(key).asc_nulls_first(), F.monotonically_increasing_id()).rowsBetween(Window.unboundedPreceding, -1)
    full = parts.join(F.broadcast(base), "_file")  # one row a file: bounded by the number of partitions
    return full.select(*df.columns, *(F.expr(f"`{c}_base`") .alias(f"{c}_base") for c in sums), *(F.coalesce(F.sum(c).over(order), F.lit(0)).alias(f"{c}_in") for c in sums)).select(
        *df.columns, *((F.col(f"{c}_base") + F.col(f"{c}_in")).alias(f"{c}_before") for c in sums)
    )


def pack(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    docs: doc_id, text; other columns are not looked at. A null or empty text is a document of the
    end id alone. Repeated rows are documents of their own. offset is always 0, as each piece is a
    sequence; no sequence is padded. ids (with_ids) are little-endian unsigned 32-bit numbers.
    """
    if sequence & (sequence - 1):
        raise ValueError("the sequence length must be a power of two")
    cut = bounded(docs).select("text", F.col("doc_id").cast("long")).mapInArrow(lean(_cut(vocabulary or default_vocabulary(), sequence, with_ids)), "doc_id long, doc_tokens long, crcs array<long>, pieces array<binary>")
    top = sequence.bit_length() - 1
    digits = [f"b{b}" for b in range(top, -1, -1)]
    count = lambda b: F.expr(f"doc_tokens div {sequence}") if b == top else F.expr(f"shiftright(doc_tokens, {b}) & 1")
    counted = cut.select("*", *(count(b).alias(f"b{b}") for b in range(top, -1, -1)))
    # written before it is dealt out by ranges, which looks at its rows twice: texts are encoded once
    once = stage(counted, "cut")
    numbered = numbered_files(once, digits, "doc_id")
    release(once)
    # the number of sequences in the longer buckets, over all documents: one row
    totals = numbered.agg(*[F.coalesce(F.max(F.col(f"{d}_before") + F.col(d)), F.lit(0)).alias(d) for d in digits]).first()
    base, first = {}, 0
    for d in digits:
        base[d], first = first, first + totals[d]
    lengths = F.concat(F.array_repeat(F.lit(sequence).cast("long"), F.col(digits[0]).cast("int")), *(F.when(F.col(f"b{b}") > 0, F.array(F.lit(1 << b).cast("long"))).otherwise(F.array().cast("array<long>")) for b in range(top - 1, -1, -1)))
    numbers = F.concat(
        F.when(F.col(digits[0]) > 0, F.sequence(F.col(f"{digits[0]}_before") + base[digits[0]], F.col(f"{digits[0]}_before") + base[digits[0]] + F.col(digits[0]) - 1)).otherwise(F.array().cast("array<long>")),
        *(F.when(F.col(d) > 0, F.array(F.col(f"{d}_before") + base[d])).otherwise(F.array().cast("array<long>")) for d in digits[1:]),
    )
    whole = numbered.select("doc_id", "doc_tokens", "pieces", F.posexplode(F.arrays_zip(lengths.alias("length"), "crcs", numbers.alias("number"))).alias("k", "p"))
    long_first = F.least(F.col("k").cast("long"), F.expr(f"doc_tokens div {sequence}")) * sequence
    # the rest's digits above a piece's own have all come before it
    rest = F.expr(f"doc_tokens % {sequence}")
    start = long_first + F.when(F.col("p.length") < sequence, rest - rest % (F.col("p.length") * 2)).otherwise(F.lit(0))
    out = [F.col("doc_id"), start.alias("start"), F.col("p.length").alias("length"), F.col("p.crcs").alias("ids_crc32"), F.col("doc_tokens"), F.col("p.number").alias("sequence_id"), F.lit(0).cast("long").alias("offset")]
    if with_ids:
        out.append(F.col("pieces")[F.col("k")].alias("ids"))
    return whole.select(*out)
