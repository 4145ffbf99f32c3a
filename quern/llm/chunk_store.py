"""Token ids in a content-addressed store.

A rolling hash over the ids cuts each document's stream at places that depend on the content alone,
so passages that repeat give equal chunks. A chunk is named by the SHA-256 of its bytes. Three
tables, all written below one folder:

packs      name, data: every distinct chunk once, in buckets of names
recipes    doc_id, row, n_tokens, digests, root, start: one row a document in ascending doc_id order
manifest   file, docs, tokens, root: one row a recipe file, the Merkle root over its documents
                   (a leaf hashes doc_id, start, n_tokens and root)

Ids are little-endian unsigned numbers of 2 bytes if the vocabulary has at most 65,536 ids, else 4.
Merkle trees hash pairs of nodes with SHA-256; an odd node is carried up.

Reading back goes by the recipes: each names its chunks, the chunks are looked up in the packs, and a
document's ids are put together again, checked against names, count and root. A chunk is a row of
bounded size, so nothing is held whole but one document. A chunk that more than one reference in
HOT_SHARE names is sent to all tasks (there are fewer than HOT_SHARE such); the others are joined.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import bounded, dealt, lean, mix, release, rows_by_key, scratch, stage, width
from quern.llm.packing import numbered_files
from quern.llm.tokens import codec, default_vocabulary, forget, runs

#: Ids under the rolling hash; a chunk ends where CUT bits of the hash are zero, or at MOST ids.
ROLL, CUT, MOST = 8, 9, 8192
HOT_SHARE = 256
_CUT = "doc_id long, row long, n_tokens long, digests binary, root binary, chunks array<struct<name:binary,data:binary>>"
_RECIPES = "doc_id long, row long, n_tokens long, digests binary, root binary, start long"


def merkle(leaves: list[bytes]) -> bytes:
    level = leaves or [b""]
    while len(level) > 1:
        level = [hashlib.sha256(level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _gear(size: int) -> np.ndarray:
    """A random number for each id: a fixed one, so the same ids are cut in the same places for ever."""
    return (mix(np.arange(1, size + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def chunk_ends(ids: np.ndarray, counts: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """Where chunks end in the ids of documents, one after the other, of `counts` ids each (none empty)."""
    last = np.cumsum(counts)
    h, m = gear[ids], 1
    while m < ROLL and len(h) > m:  # a shifted sum over ROLL ids, by doubling
        h, m = (h[:-m] << np.uint32(m)) + h[m:], 2 * m
    cut = np.flatnonzero(h < np.uint32(1 << (32 - CUT))) if m == ROLL else np.empty(0, np.int64)
    cut = cut[np.searchsorted(last, cut, "right") == np.searchsorted(last, cut + ROLL - 1, "right")] + ROLL
    ends = np.unique(np.r_[0, cut, last])
    long = np.flatnonzero(np.diff(ends) > MOST)
    return np.unique(np.concatenate([ends, *(np.arange(ends[k], ends[k + 1], MOST) for k in long)]))[1:]


def _cut(vocabulary: str, kind: str):
    """A row for each document: its recipe and its chunks."""
    w = int(kind[-1])

    def run(batches):
        words = codec(vocabulary)
        encode, gear = words.encode, _gear(len(words.ends_word))
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo, hi in runs(batch.column(0)):
                ids, n = encode(batch.column(0).slice(lo, hi - lo))
                raw, ends, last = ids.astype(kind).tobytes(), chunk_ends(ids, n, gear), np.cumsum(n)
                data = [raw[w * a : w * b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
                names = [hashlib.sha256(d).digest() for d in data]
                to = np.searchsorted(ends, last) + 1
                own = [names[a:b] for a, b in zip([0, *to.tolist()], to.tolist(), strict=False)]
                chunks = pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(data, pa.binary())], ["name", "data"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(lo, hi - lo),
                        pa.array(np.arange(row, row + len(n))),
                        pa.array(n),
                        pa.array([b"".join(x) for x in own], pa.binary()),
                        pa.array([merkle(x) for x in own], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.r_[0, to], pa.int32()), chunks),
                    ],
                    ["doc_id", "row", "n_tokens", "digests", "root", "chunks"],
                )
                row += len(n)
        forget(words)

    return run


def _read(kind: str):
    """Documents from their chunks, which come in order; raises if anything differs from the recipe."""

    def run(batches):
        for row, parts in rows_by_key(batches):
            place, names, data, head = zip(*parts, strict=True)
            if None in names or None in data or place != tuple(range(len(parts))):
                raise ValueError(f"chunks are missing for row {row}")
            if any(hashlib.sha256(d).digest() != x for x, d in zip(names, data, strict=True)):
                raise ValueError("a chunk does not have the bytes that its name says")
            ids, recipe = np.frombuffer(b"".join(data), kind), head[0]
            if len(ids) != recipe["n_tokens"] or merkle(list(names)) != recipe["root"]:
                raise ValueError(f"a recipe and its chunks differ: row {row}")
            yield (recipe["doc_id"], recipe["start"], len(ids), zlib.crc32(ids.astype("<u4").tobytes()), recipe["root"].hex())

    def batched(batches):
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        names, held = ["doc_id", "start", "n_tokens", "ids_crc32", "merkle_root"], []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
        for x in run(batches):
            held.append(x)
            if len(held) == 4096:
                yield made()
                held.clear()
        if held:
            yield made()

    return batched


def _roots(batches):
    for _, rows in rows_by_key(batches):
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        leaves = [hashlib.sha256(f"{r[1]} {r[4]} {r[3]} ".encode() + r[5]).digest() for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]]), pa.array([len(rows)], pa.int64()), pa.array([sum(r[3] for r in rows)], pa.int64()), pa.array([merkle(leaves)], pa.binary())], ["file", "docs", "tokens", "root"])


class ChunkStore:
    """The store below `path`. docs: doc_id, text; other columns are not looked at. A null or empty
    text is a document of the end id alone; repeated rows are documents of their own; ties of
    doc_id are ordered by the row's place; null ids come first. An empty table gives an empty store."""

    def __init__(self, spark: SparkSession, path: str, vocabulary: str | None = None):
        self.spark, self.path, self.vocabulary = spark, path.rstrip("/"), vocabulary or default_vocabulary()
        self.table = None  # packs as a table of this session, if it wrote them
        self.kind = "<u2" if codec(self.vocabulary).codec.get_vocab_size() <= 1 << 16 else "<u4"

    def write(self, docs: DataFrame) -> ChunkStore:
        cut = stage(bounded(docs).select("text", F.col("doc_id").cast("long")).mapInArrow(lean(_cut(self.vocabulary, self.kind)), _CUT), "cut", "zstd")
        # equal chunks meet in their own task first, so one that every document holds does not gather
        packs = cut.select(F.explode("chunks").alias("c")).groupBy("c.name").agg(F.first("c.data").alias("data"))
        # in buckets, so that they need no shuffle to be joined
        named = packs.write.bucketBy(width(self.spark), "name").sortBy("name").option("compression", "zstd").option("path", f"{self.path}/packs")
        self.table = f"packs_{uuid.uuid4().hex}"
        named.format("parquet").saveAsTable(self.table)
        ordered = numbered_files(cut.drop("chunks"), ["n_tokens"], "doc_id").withColumnRenamed("n_tokens_before", "start")
        ordered.write.parquet(f"{self.path}/recipes")
        self._filed().write.parquet(f"{self.path}/manifest")
        release(cut)
        return self

    def _filed(self) -> DataFrame:
        """The manifest that the recipe files as they are should have."""
        filed = self.recipes.select(F.xxhash64(F.col("_metadata.file_name")).alias("key"), F.col("_metadata.file_name").alias("file"), "doc_id", "row", "n_tokens", "start", "root")
        return dealt(filed, "key").mapInArrow(_roots, "file string, docs long, tokens long, root binary")

    def _verify_manifest(self) -> None:
        """Raises ValueError if the recipe files and the manifest differ."""
        same = F.col("m.file").eqNullSafe(F.col("r.file"))
        for c in ("docs", "tokens", "root"):
            same = same & F.col(f"m.{c}").eqNullSafe(F.col(f"r.{c}"))
        both = self.manifest.alias("m").join(self._filed().alias("r"), F.col("m.file") == F.col("r.file"), "full_outer")
        wrong = both.where(~same).select(F.coalesce("m.file", "r.file")).first()
        if wrong:
            raise ValueError(f"the manifest and a recipe file differ: {wrong[0]}")

    @property
    def packs(self) -> DataFrame:
        return self.spark.table(self.table) if self.table else self.spark.read.schema("name binary, data binary").parquet(f"{self.path}/packs")

    @property
    def recipes(self) -> DataFrame:
        return self.spark.read.schema(_RECIPES).parquet(f"{self.path}/recipes")

    @property
    def manifest(self) -> DataFrame:
        return self.spark.read.schema("file string, docs long, tokens long, root binary").parquet(f"{self.path}/manifest")

    def read_back(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32, merkle_root of every document, put together by its recipe from
        the chunks in the packs. Chunks must have the bytes that their names say, documents the count and
        the Merkle root that their recipes say, recipe files the roots that the manifest says."""
        self._verify_manifest()
        named = F.expr("transform(sequence(0, greatest(length(digests) div 32 - 1, 0)), i -> substring(digests, 32 * i + 1, 32))")
        refs = self.recipes.select("row", "doc_id", "start", "n_tokens", "root", F.posexplode(named).alias("place", "name"))
        refs = refs.select("row", "place", "name", F.when(F.col("place") == 0, F.struct("doc_id", "start", "n_tokens", "root")).alias("head"))
        often = refs.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
        total = often.agg(F.sum("n")).first()[0] or 0
        # fewer than HOT_SHARE chunks of MOST ids: at most 8 MB
        hot = self.packs.join(F.broadcast(often.where(F.col("n") > total // HOT_SHARE + width(self.spark)).select("name")), "name", "left_semi")
        known = refs.join(F.broadcast(hot.withColumnRenamed("data", "known")), "name", "left")
        rest = known.where("known is null").drop("known").join(self.packs, "name", "left")
        columns = ["row", "place", "name", "data", "head"]
        parts = known.where("known is not null").withColumnRenamed("known", "data").select(columns).unionByName(rest.select(columns))
        parts = parts.repartition(width(self.spark), "row").sortWithinPartitions("row", "place")
        return parts.mapInArrow(lean(_read(self.kind)), "doc_id long, start long, n_tokens long, ids_crc32 long, merkle_root string")


def stored(docs: DataFrame, vocabulary: str | None = None) -> ChunkStore:
    """Writes docs to a new store in the shared folder."""
    return ChunkStore(docs.sparkSession, scratch(docs.sparkSession, "chunks"), vocabulary).write(docs)
