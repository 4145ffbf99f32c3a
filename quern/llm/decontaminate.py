"""Benchmark decontamination with an FM-index for every training shard.

A shard is a bounded run of whole documents. Words that occur in no benchmark item can be in no hit,
so they are barriers: a shard's sequence holds the maximal runs of benchmark words, each distinct
run once, with barriers between. Its suffix array gives the Burrows-Wheeler transform; a wavelet tree
over it answers rank queries; all benchmark windows are searched backwards together; an occurrence's
place is found by walking back to the next sampled suffix. Spans of hit words are merged by counting.

The pass over the documents needs no shuffle. Only the benchmark is broadcast, at most BLOCK_BYTES of
its text at once: a larger one is searched block after block, and the spans and items of all blocks
are merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ALNUM, bounded, gather, lean, stage, texts

WINDOW = 13
#: Words of a shard; suffixes are sampled at every 8th place.
SHARD, SAMPLE = 1_500_000, 8
#: Benchmark text that is broadcast at once.
BLOCK_BYTES = 8 << 20


class FmIndex:
    """Backward search over a sequence of symbols 1..sigma-1, and 0 as barrier."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.n = n = len(seq)
        suffixes = _suffix_array(seq)
        bwt = seq[suffixes - 1]  # cyclic: before the first symbol comes the last, a barrier
        self.less = np.r_[0, np.cumsum(np.bincount(seq, minlength=sigma))]
        self.bits = max(1, int(sigma - 1).bit_length())
        # wavelet tree, level by level, as a matrix: a stable partition by one bit a level
        self.ranks, self.zeros, now = [], [], bwt
        for level in range(self.bits - 1, -1, -1):
            bit = (now >> level) & 1
            self.ranks.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(n - int(self.ranks[-1][-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.at = np.where(suffixes % SAMPLE == 0, suffixes, -1).astype(np.int32)
        self.bwt = bwt

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol among the first i symbols of the transform."""
        lo, hi = np.zeros_like(i), i
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = self.ranks[k][lo], self.ranks[k][hi]
            lo, hi = np.where(one, self.zeros[k] + a, lo - a), np.where(one, self.zeros[k] + b, hi - b)
        return hi - lo

    def search(self, patterns: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that begin with each row of patterns."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(length - 1, -1, -1):
            c = patterns[live, k]
            lo[live] = self.less[c] + self.rank(c, lo[live])
            hi[live] = self.less[c] + self.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffixes: steps back through the transform until a sampled one."""
        place, steps, live, row = np.empty(len(rows), np.int64), 0, np.arange(len(rows)), rows.copy()
        while len(live):
            got = self.at[row[live]] >= 0
            place[live[got]] = self.at[row[live[got]]] + steps
            live = live[~got]
            c = self.bwt[row[live]]
            row[live] = self.less[c] + self.rank(c, row[live])
            steps += 1
        return place % self.n


def _suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a cyclic sequence, by doubling; groups of one are not sorted again."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    s = seq[order]
    head = np.r_[True, s[1:] != s[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    k = 1
    while True:
        tail = np.r_[head[1:], True]
        open_ = np.flatnonzero(~(head & tail))  # places in groups of two or more
        if not len(open_) or k >= n:
            return order
        who = order[open_]
        group, nxt = rank[who], rank[(who + k) % n]
        again = np.argsort(group * n + nxt, kind="stable")
        who, group, nxt = who[again], group[again], nxt[again]
        order[open_] = who
        fresh = np.r_[True, (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])]
        head[open_] = fresh
        rank[who] = np.maximum.accumulate(np.where(fresh, open_, 0))
        k *= 2


@dataclass
class Phrases:
    """All windows of a block of items: distinct patterns of each length, and the items they are of."""

    words: dict[bytes, int]
    patterns: list[tuple[int, np.ndarray, list[np.ndarray]]]
    items: list[str]

    @staticmethod
    def of(rows: list[tuple[int, bytes | None]], window: int) -> Phrases:
        words: dict[bytes, int] = {}
        found: dict[int, dict[tuple, set[int]]] = {}
        items, places = [], {}
        for item, text in rows:
            if item is None:
                k = -1  # its windows hit, but it has no name to list
            elif (k := places.setdefault(str(item), len(items))) == len(items):
                items.append(str(item))
            ids = [words.setdefault(w, len(words) + 1) for w in (text or b"").translate(ALNUM).split()]
            m = min(len(ids), window)
            for i in range(len(ids) - m + 1 if m else 0):
                found.setdefault(m, {}).setdefault(tuple(ids[i : i + m]), set()).add(k)
        patterns = [(m, np.array(list(w), np.int64), [np.fromiter(s, np.int64) for s in w.values()]) for m, w in sorted(found.items())]
        return Phrases(words, patterns, items)

    @property
    def least(self) -> int:
        return min((m for m, _, _ in self.patterns), default=1)


def _hits(ids: np.ndarray, counts: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, list[set[int]]]:
    """For the words of some documents (0: not a benchmark word): which are hit; the items of each text."""
    hit, items = np.zeros(len(ids) + 1, np.int32), [set() for _ in counts]
    doc = np.repeat(np.arange(len(counts)), counts)
    inside = ids > 0
    if not inside.any() or not phrases.patterns:
        return hit[:-1] > 0, items
    edge = np.r_[True, doc[1:] != doc[:-1]]
    begin = np.flatnonzero(inside & (edge | np.r_[True, ~inside[:-1]]))
    last = np.flatnonzero(inside & np.r_[edge[1:] | ~inside[1:], True])
    size = last - begin + 1
    long = size >= phrases.least
    begin, size = begin[long], size[long]
    if not len(begin):
        return hit[:-1] > 0, items
    # each distinct run once: its first place in the shard's sequence, and all places in the documents
    narrow = ids.astype(np.int32).tobytes()
    runs: dict[bytes, list[int]] = {}
    for b, s in zip(begin.tolist(), size.tolist(), strict=True):
        runs.setdefault(narrow[4 * b : 4 * (b + s)], []).append(b)
    own = [np.frombuffer(r, np.int32) for r in runs]
    length = np.fromiter(map(len, own), np.int64, len(own))
    starts = np.cumsum(length + 1) - length - 1
    seq = np.zeros(int((length + 1).sum()), np.int64)
    seq[gather(starts, length)] = np.concatenate(own)
    places = [np.array(p, np.int64) for p in runs.values()]
    many = np.fromiter(map(len, places), np.int64, len(places))
    flat, first = np.concatenate(places), np.cumsum(many) - many
    index = FmIndex(seq, len(phrases.words) + 1)
    for m, patterns, of in phrases.patterns:
        lo, hi = index.search(patterns, m)
        got = np.flatnonzero(hi > lo)
        if not len(got):
            continue
        n = hi[got] - lo[got]
        at = index.locate(gather(lo[got], n))
        which = np.repeat(got, n)
        run = np.searchsorted(starts, at, "right") - 1
        # every copy of the run, in every document
        word = flat[gather(first[run], many[run])] + np.repeat(at - starts[run], many[run])
        which = np.repeat(which, many[run])
        np.add.at(hit, word, 1)
        np.add.at(hit, word + m, -1)
        for d, p in set(zip(doc[word].tolist(), which.tolist(), strict=True)):
            items[d].update(of[p].tolist())
        for found in items:
            found.discard(-1)
    return np.cumsum(hit[:-1]) > 0, items


def _scan(phrases_of, window: int, keep_words: bool, key_type: pa.DataType = pa.int64()):  # noqa: B008
    """(row columns, n_words, n_hit, items, kept spans) of each document, shard after shard."""

    def run(batches):
        phrases = Phrases.of(phrases_of.value, window)
        code = phrases.words.get

        def shard(rows):
            column = [r[0] for r in rows]
            split = [(t or b"").translate(ALNUM).split() for t in column]
            counts = np.fromiter(map(len, split), np.int64, len(split))
            ids = np.fromiter((code(w, 0) for s in split for w in s), np.int64, int(counts.sum()))
            hit, items = _hits(ids, counts, phrases)
            ends = np.cumsum(counts)
            out = []
            for k, (e, c) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
                h = hit[e - c : e]
                spans = None
                if keep_words:
                    edge = np.flatnonzero(np.diff(np.r_[0, h.astype(np.int8), 0]))
                    spans = edge.tolist()
                out.append((rows[k][1], c, int(h.sum()), sorted(phrases.items[i] for i in items[k]), spans))
            cols = list(zip(*out, strict=True))
            types = (key_type, pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "n_words", "n_hit", "items", "spans"])

        rows, held = [], 0
        for batch in batches:
            for t, key in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                rows.append((t, key))
                held += len(t or b"")
                if held >= 6 * SHARD:
                    yield shard(rows)
                    rows, held = [], 0
        if rows:
            yield shard(rows)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, spans: bool = False, key: str = "long") -> DataFrame:
    """doc_id, n_words, n_hit, items (ids of the items with occurring windows), spans of hit words.

    docs: doc_id, text; benchmark: item_id, text; more columns are not looked at. Null and empty
    texts have no words; an item without words has no window. Rows may repeat: each is judged alone.
    Benchmark rows of one item_id are one item; those of a null id hit words, but are not listed.
    An empty benchmark hits nothing. spans: begin and end places of merged runs of hit words, flat.
    """
    spark = bounded(docs).sparkSession
    blocks, held = [[]], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        t = None if r["text"] is None else r["text"].encode()
        if held and held + len(t or b"") > BLOCK_BYTES:
            blocks.append([])
            held = 0
        blocks[-1].append((r["item_id"], t))
        held += len(t or b"")
    key_type = pa.string() if key == "string" else pa.int64()
    kind = f"doc_id {key}, n_words long, n_hit long, items array<string>, spans array<long>"
    if len(blocks) == 1:
        shared = spark.sparkContext.broadcast(blocks[0])
        return docs.select("text", F.col("doc_id").cast(key)).mapInArrow(lean(_scan(shared, window, spans, key_type)), kind)
    # block after block; what each finds in a text goes under the text's digest, so equal texts share it
    found = None
    for block in blocks:
        shared = spark.sparkContext.broadcast(block)
        own = docs.where("text is not null").select("text", F.md5("text").alias("key"))
        hits = own.mapInArrow(_scan(shared, window, True, pa.string()), kind.replace(f"doc_id {key}", "doc_id string"))
        hits = hits.where("n_hit > 0").dropDuplicates(["doc_id"])
        hits = stage(hits.select(F.col("doc_id").alias("_key"), "items", "spans"), "hits")
        shared.unpersist()
        found = hits if found is None else found.unionByName(hits)
    merged = found.groupBy("_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    own = docs.select("text", F.col("doc_id").cast(key)).withColumn("_key", F.md5("text"))
    return own.join(merged, "_key", "left").select("text", "doc_id", "items", "spans").mapInArrow(_counted(spans, key_type), kind)


def _counted(keep_words: bool, key_type: pa.DataType):
    """The columns of _scan from texts, their items, and their spans of all blocks."""

    def run(batches):
        for batch in batches:
            out = []
            for t, key, items, spans in zip(texts(batch.column(0)), *(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                n = len((t or b"").translate(ALNUM).split())
                change = np.zeros(n + 1, np.int64)
                np.add.at(change, np.array(spans[::2] if spans else [], np.int64), 1)
                np.add.at(change, np.array(spans[1::2] if spans else [], np.int64), -1)
                hit = np.cumsum(change[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0])).tolist()
                out.append((key, n, int(hit.sum()), items or [], edge if keep_words else None))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            types = (key_type, pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "n_words", "n_hit", "items", "spans"])

    return run


def judged(docs: DataFrame, benchmark: DataFrame, key: str = "long") -> DataFrame:
    """The contract's columns: n_items, items_sha256 and contaminated beside the counts; key: the type of doc_id, long or string."""
    found = contamination(docs, benchmark, key=key)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def clean_of(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones, all columns kept. Each row is judged by its own text, whatever its key."""
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    gone = judged(docs.select("text", key.alias("doc_id")), benchmark, "string").where("contaminated").select(F.col("doc_id").alias("_key")).distinct()
    return docs.join(gone, key == F.col("_key"), "left_anti").select(*docs.columns)
