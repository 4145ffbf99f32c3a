"""Substring dedup: words go that lie in a window of 35 words which also starts anywhere else.

Method: a log-structured fingerprint index. Each window is filed under an anchor, the least 8-gram
hash inside it, so equal windows always have equal anchors. A task writes its windows as runs:
immutable, sorted by anchor, one for each bucket of anchors. A bucket merge-joins the runs of a batch
with the runs of history; where an anchor meets itself its windows are compared by their own hashes
(anchor and window hash together make 112 bits), and those found twice are reported to their rows.
`FingerprintIndex` keeps the runs of all batches so far and compacts them to one run a bucket.

Plan of a batch: one pass over the texts, a shuffle of packed runs (about 7.6 bytes a word), a small
shuffle of bit masks back, and a join of the masks with the texts. Windows are judged on the input,
and counts cover every occurrence, so an anchor that a third of all documents hold is one long run
of fixed-size entries in one bucket, never a set of pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import WordHash, bounded, by_key, dealt, gather, mix, texts, width, windows

WINDOW, GRAM = 35, 8
#: Bytes of text from which a task cuts one set of runs.
HELD = 10 << 20
#: Buckets of an index; a merged index keeps them for good.
BUCKETS = 4096

_words = WordHash()
ENTRY = np.dtype([("anchor", "<u8"), ("row", "<i8"), ("start", "<u4"), ("n", "u1")])
FOUND = np.dtype([("row", "<i8"), ("start", "<u4"), ("mask", "<u4")])


def row_key(*names: str):
    """A row's own key: equal rows share it, and their windows count once for each of them."""
    return F.xxhash64(*names)


def anchored(h: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For word hashes h: (anchor hash, first window, number of windows) of each run of valid windows
    with one anchor; valid[i]: the window that starts at word i lies in one document."""
    g = windows(h, GRAM)
    if len(g) < WINDOW - GRAM + 1:
        e = np.empty(0, np.int64)
        return e.astype(np.uint64), e, e
    at, m = np.arange(len(g)), 1
    join = lambda a, b: np.where(g[a] <= g[b], a, b)  # noqa: E731  the leftmost of equals
    while m * 2 <= WINDOW - GRAM + 1:
        at = join(at[:-m], at[m:])
        m *= 2
    rest = WINDOW - GRAM + 1 - m
    if rest:
        at = join(at[: len(at) - rest], at[rest:])
    ok = np.flatnonzero(valid[: len(at)])
    at = at[ok]
    if not len(at):
        return g[:0], at, at
    head = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (ok[1:] != ok[:-1] + 1)])
    return g[at[head]], ok[head], np.diff(np.r_[head, len(at)])


def _runs(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]):
        def cut(column, rows):
            split = [t.split() for t in column]
            counts = np.fromiter(map(len, split), np.int64, len(split))
            h = _words.of([w for s in split for w in s])
            begin = np.cumsum(counts) - counts
            valid = np.zeros(len(h) + 1, np.int8)
            long = counts >= WINDOW
            np.add.at(valid, begin[long], 1)
            np.add.at(valid, (begin + counts)[long] - WINDOW + 1, -1)
            anchor, first, n = anchored(h, np.cumsum(valid[:-1]) > 0)
            if not len(anchor):
                return None
            doc = np.searchsorted(begin, first, "right") - 1
            # an empty document shares its place with the next one, which is the one that counts
            entry = np.empty(len(anchor), ENTRY)
            entry["anchor"], entry["row"], entry["start"], entry["n"] = anchor, np.array(rows, np.int64)[doc], first - begin[doc], n
            w = windows(h, WINDOW)
            bucket = (mix(anchor) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((anchor, bucket))
            entry, bucket, first, n = entry[order], bucket[order], first[order], n[order]
            inner = w[gather(first, n)]
            low, high = inner.astype(np.uint32), (inner >> np.uint64(32)).astype(np.uint16)
            ends = np.r_[0, np.cumsum(n)]
            cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
            keys, blobs = [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                keys.append(int(bucket[a]))
                blobs.append(b"".join((np.uint32(b - a).tobytes(), entry[a:b].tobytes(), low[ends[a] : ends[b]].tobytes(), high[ends[a] : ends[b]].tobytes())))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "run"])

        column, rows, held = [], [], 0
        for batch in batches:
            for t, r in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                if t:
                    column.append(t)
                    rows.append(r)
                    held += len(t)
                if held >= HELD:
                    if (got := cut(column, rows)) is not None:
                        yield got
                    column, rows, held = [], [], 0
        if column and (got := cut(column, rows)) is not None:
            yield got

    return run


def _opened(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(entries, window hashes) of runs, merged in the order of the anchors."""
    entries, lows, highs = [], [], []
    for x in blobs:
        k = int(np.frombuffer(x, "<u4", 1)[0])
        e = np.frombuffer(x, ENTRY, k, 4)
        m, at = int(e["n"].sum(dtype=np.int64)), 4 + ENTRY.itemsize * k
        entries.append(e)
        lows.append(np.frombuffer(x, "<u4", m, at))
        highs.append(np.frombuffer(x, "<u2", m, at + 4 * m))
    e = np.concatenate(entries)
    w = np.concatenate(lows).astype(np.uint64) | np.concatenate(highs).astype(np.uint64) << np.uint64(32)
    return e, w


def _repeated(groups: int):
    """Merges a bucket's runs; gives masks of the windows that occur twice, by group of rows.

    Runs of history carry row 0 in entries of n windows; they are met but not reported.
    """

    def run(batches):
        for _, blobs in by_key(batches):
            old = [x[1:] for x in blobs if x[:1] == b"h"]
            new = [x[1:] for x in blobs if x[:1] == b"n"]
            if not new:
                continue
            e, w = _opened(new + old)
            fresh = np.zeros(len(e), bool)
            fresh[: sum(int(np.frombuffer(x, "<u4", 1)[0]) for x in new)] = True
            begin = np.cumsum(e["n"], dtype=np.int64) - e["n"]
            order = np.argsort(e["anchor"], kind="stable")
            a = e["anchor"][order]
            group = np.cumsum(np.r_[False, a[1:] != a[:-1]])
            size = np.bincount(group)
            order = order[size[group] > 1]  # an anchor that is met once holds no repeat
            if not len(order):
                continue
            n = e["n"][order].astype(np.int64)
            own, anchor = w[gather(begin[order], n)], np.repeat(e["anchor"][order], n)
            who, bit = np.repeat(np.arange(len(order)), n), gather(np.zeros(len(n), np.int64), n)
            by = np.lexsort((own, anchor))
            same = (own[by][1:] == own[by][:-1]) & (anchor[by][1:] == anchor[by][:-1])
            twice = np.zeros(len(own), bool)
            twice[by[1:]] |= same
            twice[by[:-1]] |= same
            mask = np.zeros(len(order), np.uint32)
            np.bitwise_or.at(mask, who[twice], np.uint32(1) << bit[twice].astype(np.uint32))
            hit = np.flatnonzero((mask > 0) & fresh[order])
            found = np.empty(len(hit), FOUND)
            found["row"], found["start"], found["mask"] = e["row"][order[hit]], e["start"][order[hit]], mask[hit]
            if not len(found):
                continue
            key = (mix(found["row"].view(np.uint64)) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(key, kind="stable")
            found, key = found[order], key[order]
            cuts = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
            yield pa.RecordBatch.from_arrays([pa.array(key[cuts[:-1]], pa.int32()), pa.array([found[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["grp", "run"])

    return run


def _by_row(batches):
    """(row, its masks) from groups of rows."""
    for _, blobs in by_key(batches):
        f = np.concatenate([np.frombuffer(x, FOUND) for x in blobs])
        f = f[np.argsort(f["row"], kind="stable")]
        at = np.r_[np.flatnonzero(np.r_[True, f["row"][1:] != f["row"][:-1]]), len(f)]
        yield pa.RecordBatch.from_arrays([pa.array(f["row"][at[:-1]]), pa.array([f[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["row", "masks"])


def _merged(batches):
    """One run a bucket for history: each distinct window once."""
    for bucket, blobs in by_key(batches):
        e, w = _opened([x[1:] for x in blobs])
        anchor = np.repeat(e["anchor"], e["n"])
        order = np.lexsort((w, anchor))
        anchor, w = anchor[order], w[order]
        keep = np.r_[True, (anchor[1:] != anchor[:-1]) | (w[1:] != w[:-1])]
        anchor, w = anchor[keep], w[keep]
        out = np.zeros(len(w), ENTRY)
        out["anchor"], out["n"] = anchor, 1
        blob = b"h" + np.uint32(len(w)).tobytes() + out.tobytes() + w.astype(np.uint32).tobytes() + (w >> np.uint64(32)).astype(np.uint16).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "run"])


def _kept(words: list[bytes], masks: bytes | None) -> list[bytes]:
    if not masks:
        return words
    f = np.frombuffer(masks, FOUND)
    bit = np.arange(WINDOW - GRAM + 1, dtype=np.uint32)
    starts = (f["start"].astype(np.int64)[:, None] + bit)[(f["mask"][:, None] >> bit & 1) > 0]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    return [w for w, c in zip(words, np.cumsum(cover[:-1]).tolist(), strict=True) if not c]


def _digest(batches):
    for batch in batches:
        out = []
        for t, m in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            words = (t or b"").split()
            kept = _kept(words, m)
            out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        n, gone, name = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(name, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _texts(batches):
    for batch in batches:
        kept = [None if t is None else t.decode() if not m else b" ".join(_kept(t.split(), m)).decode() for t, m in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], ["doc_id", "text"])


def batch_runs(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, run) of a batch of documents (doc_id, text)."""
    return bounded(docs).select("text", row_key("doc_id", "text").alias("row")).mapInArrow(_runs(buckets), "bucket int, run binary").select("bucket", F.concat(F.lit(b"n"), "run").alias("run"))


def masked(docs: DataFrame, history: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """doc_id, text, masks of every row of docs; masks: the row's windows that start elsewhere too."""
    p = width(docs.sparkSession)
    buckets = buckets or 2 * p
    runs = batch_runs(docs, buckets)
    if history is not None:
        runs = runs.unionByName(history)
    found = dealt(runs, "bucket").mapInArrow(_repeated(p), "grp int, run binary")
    masks = dealt(found, "grp").mapInArrow(_by_row, "row long, masks binary")
    return docs.select("doc_id", "text", row_key("doc_id", "text").alias("row")).join(masks, "row", "left").select("doc_id", "text", "masks")


def repeats_removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs, judged among themselves.

    Null and empty texts have no words. A text of fewer than 35 words has no window and stays. Rows
    that repeat as a whole are occurrences of their own: each loses what the others hold. Other
    columns are not looked at.
    """
    return masked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


class FingerprintIndex:
    """Runs of all batches so far below `path`, for incremental dedup.

    add(batch) gives the batch's texts without the windows that history, or the batch itself, holds
    elsewhere, and files the batch's runs as a new generation. compact() merges all generations
    into one, with each distinct window once. A text loses words only to windows seen until then.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.generations, self.batches = spark, path.rstrip("/"), [], 0

    def _history(self) -> DataFrame | None:
        parts = [self.spark.read.schema("bucket int, run binary").parquet(g) for g in self.generations]
        out = None
        for part in parts:
            out = part if out is None else out.unionByName(part)
        return out

    def add(self, docs: DataFrame) -> DataFrame:
        kept = masked(docs, self._history(), BUCKETS).select("doc_id", "text", "masks").mapInArrow(_texts, "doc_id long, text string")
        n, self.batches = self.batches, self.batches + 1
        kept.write.parquet(f"{self.path}/kept-{n}")
        run = f"{self.path}/run-{n}"
        dealt(batch_runs(docs, BUCKETS), "bucket").mapInArrow(_merged, "bucket int, run binary").write.parquet(run)
        self.generations.append(run)
        return self.spark.read.schema("doc_id long, text string").parquet(f"{self.path}/kept-{n}")

    def compact(self) -> FingerprintIndex:
        if len(self.generations) > 1:
            path = f"{self.path}/merged-{self.batches}"
            dealt(self._history(), "bucket").mapInArrow(_merged, "bucket int, run binary").write.parquet(path)
            self.generations = [path]
        return self
