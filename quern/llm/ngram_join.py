"""N-gram Jaccard join: exact components of texts whose 5-word shingle sets have Jaccard >= 0.8.

Method: multiple global orders. Tokens are ranked by several total orders, each with rare tokens
first; two sets that are similar enough must share a token among the first few under *every* order,
so the filters of all orders are intersected before a pair is verified.

Plan
1. Each task cuts its texts into sets of 64-bit shingle hashes. Equal sets carry one set id (a hash
   of the set), so copies collapse before anything is paired. Tokens go to buckets as packed runs.
2. A bucket counts in how many sets each token lies. Tokens of one set only cannot link anything:
   they stand first in every order, and only their number is needed. The others go on to the bucket
   of their set.
3. A set of which fewer than 80 % of the tokens occur elsewhere has a prefix of unshared tokens only
   and leaves. The others form a small table with all shared tokens, rarest first.
4. Each set joins the family of the set that it meets most often as the hub of its prefix tokens'
   groups. Families are compared whole, in blocks, by matrix products, and give only as many links
   as connect them: a group of near copies is never written out as pairs.
5. Pairs of different families and components that share a prefix token under the first order, in a
   place that leaves room for the intersection, meet the other orders, then their tokens are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import LOWER, WordHash, bounded, by_key, components, dealt, gather, lean, mix, release, rows_by_key, stage, texts, width, windows

SHINGLE = 5
#: Words that a task holds at once, of which its worker needs some 100 bytes each at its peak.
CHUNK = 200_000
U8, U4, U1 = np.dtype("<u8"), np.dtype("<u4"), np.dtype("u1")
#: Sets of a family that are compared in one task with as many others.
BLOCK = 512
#: Seeds of the further global orders.
ORDERS = (0xA24BAED4963EE407, 0x9FB21C651E98DF25)

_words = WordHash()


def shingle_sets(column: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set sizes, set ids, tokens): the distinct shingle hashes of each text, text after text."""
    split = [(t or b"").translate(LOWER).split() for t in column]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    h = _words.of([w for s in split for w in s])
    starts = np.cumsum(counts) - counts
    n = np.maximum(counts - SHINGLE + 1, 0)
    tok = windows(h, SHINGLE)[gather(starts, n)] if n.any() else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(split)), n)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):  # the whole sequence is the one token
        whole = np.array([windows(h[starts[i] : starts[i] + counts[i]], int(counts[i]), 0x5851F42D4C957F2D + 2 * int(counts[i]))[0] for i in short], np.uint64)
        tok, doc = np.concatenate([tok, whole]), np.concatenate([doc, short])
    order = np.lexsort((tok, doc))
    tok, doc = tok[order], doc[order]
    if len(tok):
        fresh = np.r_[True, (tok[1:] != tok[:-1]) | (doc[1:] != doc[:-1])]
        tok, doc = tok[fresh], doc[fresh]
    size = np.bincount(doc, minlength=len(split)).astype(np.int64)
    sid = np.zeros(len(split), np.uint64)
    if len(tok):
        at = (np.cumsum(size) - size)[size > 0]
        place = np.arange(len(tok)) - np.repeat(at, size[size > 0])
        mixed = mix(tok ^ mix(place.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))
        sid[size > 0] = mix(np.add.reduceat(mixed, at) ^ mix(size[size > 0].astype(np.uint64)))
    return size, sid, tok


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[list]]:
    """Columns of rows whose texts (the first column) hold about `limit` bytes."""
    rows, held = None, 0
    for batch in batches:
        cols = [texts(batch.column(0)), *(c.to_pylist() for c in batch.columns[1:])]
        for row in zip(*cols, strict=True):
            rows = rows or [[] for _ in row]
            for c, v in zip(rows, row, strict=True):
                c.append(v)
            held += len(row[0] or b"")
            if held >= limit:
                yield rows
                rows, held = None, 0
    if rows:
        yield rows


def _packed(keys: list[int], blobs: list[bytes], name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], [name, "run"])


def _token_runs(buckets: int):
    """Packed runs (bucket, [sets, tokens, set ids, set sizes, tokens per set, tokens])."""

    def run(batches):
        seen: set[int] = set()
        for (column,) in _chunks(batches, CHUNK * 6):
            size, sid, tok = shingle_sets(column)
            fresh = np.array([s > 0 and not (i in seen or seen.add(i)) for s, i in zip(size.tolist(), sid.tolist(), strict=True)], bool)
            tok = tok[np.repeat(fresh, size)]
            size, sid = size[fresh], sid[fresh]
            if not len(tok):
                continue
            doc = np.repeat(np.arange(len(size)), size)
            bucket = ((tok >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            tok, doc, bucket = tok[order], doc[order], bucket[order]
            cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(tok)]
            keys, blobs = [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                d = doc[a:b]
                at = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
                own, per = d[at], np.diff(np.r_[at, b - a])
                keys.append(int(bucket[a]))
                blobs.append(b"".join((np.array([len(own), b - a], U4).tobytes(), sid[own].tobytes(), size[own].astype(U4).tobytes(), per.astype(U4).tobytes(), tok[a:b].tobytes())))
            yield _packed(keys, blobs, "bucket")

    return run


def _read_token_runs(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sids, sizes, toks = [], [], []
    for x in blobs:
        d, m = np.frombuffer(x, U4, 2).tolist()
        per = np.frombuffer(x, U4, d, 8 + 12 * d).astype(np.int64)
        sids.append(np.repeat(np.frombuffer(x, U8, d, 8), per))
        sizes.append(np.repeat(np.frombuffer(x, U4, d, 8 + 8 * d), per))
        toks.append(np.frombuffer(x, U8, m, 8 + 16 * d))
    return np.concatenate(sids), np.concatenate(sizes), np.concatenate(toks)


def _shared_tokens(groups: int):
    """From token buckets to set groups: tokens of two sets or more, with the class of their count."""

    def run(batches):
        for _, blobs in by_key(batches):
            sid, size, tok = _read_token_runs(blobs)
            order = np.lexsort((sid, tok))
            sid, size, tok = sid[order], size[order], tok[order]
            fresh = np.r_[True, (tok[1:] != tok[:-1]) | (sid[1:] != sid[:-1])]
            sid, size, tok = sid[fresh], size[fresh], tok[fresh]
            at = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
            df = np.diff(np.r_[at, len(tok)])
            cls = np.repeat(np.minimum(np.floor(4 * np.log2(df)), 255).astype(U1), df)
            keep = np.repeat(df > 1, df)
            sid, size, tok, cls = sid[keep], size[keep], tok[keep], cls[keep]
            if not len(tok):
                continue
            group = ((sid >> np.uint64(20)) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            sid, size, tok, cls, group = sid[order], size[order], tok[order], cls[order], group[order]
            cuts = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(tok)]
            keys, blobs = [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                keys.append(int(group[a]))
                blobs.append(sid[a:b].tobytes() + tok[a:b].tobytes() + size[a:b].astype(U4).tobytes() + cls[a:b].tobytes())
            yield _packed(keys, blobs, "grp")

    return run


def _surviving_sets(batches):
    """Sets of which at least 80 % of the tokens are shared: (sid, n, tokens rarest first, classes)."""
    for _, blobs in by_key(batches):
        parts = []
        for x in blobs:
            m = len(x) // 21
            parts.append((np.frombuffer(x, U8, m), np.frombuffer(x, U8, m, 8 * m), np.frombuffer(x, U4, m, 16 * m), np.frombuffer(x, U1, m, 20 * m)))
        sid, tok, size, cls = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((tok, cls, sid))
        sid, tok, size, cls = sid[order], tok[order], size[order], cls[order]
        at = np.flatnonzero(np.r_[True, sid[1:] != sid[:-1]])
        per = np.diff(np.r_[at, len(sid)])
        keep = np.flatnonzero(5 * per >= 4 * size[at].astype(np.int64))
        for part in np.array_split(keep, max(1, len(keep) // 500)):
            if len(part):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(sid[at[part]].view(np.int64)),
                        pa.array(size[at[part]].astype(np.int32)),
                        pa.array([tok[at[i] : at[i] + per[i]].tobytes() for i in part], pa.binary()),
                        pa.array([cls[at[i] : at[i] + per[i]].tobytes() for i in part], pa.binary()),
                    ],
                    ["sid", "n", "toks", "cls"],
                )


def _prefix(n: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """How many of a set's shared tokens lie in its prefix: all but 80 % of its tokens, and one more."""
    return n - (4 * n + 4) // 5 + 1 - (n - shared)


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length bound: a set cannot hold 80 % of one that is more than a quarter larger."""
    return 5 * np.minimum(a, b) >= 4 * np.maximum(a, b)


def _postings(buckets: int):
    """(bucket, run) of the prefix tokens of each set: token, set, size, component, place."""

    def run(batches):
        for batch in batches:
            sid, n, comp, fam = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 3, 4))
            toks = [np.frombuffer(x, U8) for x in batch.column(2).to_pylist()]
            m = np.fromiter(map(len, toks), np.int64, len(toks))
            q = _prefix(n, m)
            tok = np.concatenate([t[:k] for t, k in zip(toks, q.tolist(), strict=True)] or [np.empty(0, U8)])
            row = np.repeat(np.arange(len(q)), q)
            place = np.arange(len(tok)) - np.repeat(np.cumsum(q) - q, q) + np.repeat(n - m, q)
            bucket = ((tok >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]), len(order)] if len(order) else [0]
            keys, blobs = [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                o = order[a:b]
                keys.append(int(bucket[o[0]]))
                blobs.append(np.stack([tok[o].view(np.int64), sid[row[o]], n[row[o]], comp[row[o]], fam[row[o]], place[o]]).astype("<i8").tobytes())
            if keys:
                yield _packed(keys, blobs, "bucket")

    return run


def _groups(batches):
    """The postings of each bucket, sorted by token and set, and where each token begins."""
    for _, blobs in by_key(batches):
        tok, sid, n, comp, fam, place = np.concatenate([np.frombuffer(x, "<i8").reshape(6, -1) for x in blobs], axis=1)
        order = np.lexsort((sid, tok))
        tok, sid, n, comp, fam, place = tok[order], sid[order], n[order], comp[order], fam[order], place[order]
        yield sid, n, comp, fam, place, np.r_[np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]]), len(tok)]


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _hubs(batches):
    """Each set with the hub of each of its tokens' groups, the member of the least hash; how often."""
    for sid, n, _, _, _, cuts in _groups(batches):
        rank, per = mix(sid.view(np.uint64)), np.diff(cuts)
        hub = np.repeat(np.flatnonzero(rank == np.repeat(np.minimum.reduceat(rank, cuts[:-1]), per)), per)
        ok = (sid != sid[hub]) & _alike(n, n[hub])
        got, times = np.unique(np.stack([sid[ok], sid[hub[ok]]]), axis=1, return_counts=True)
        if got.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1]), pa.array(times)], ["sid", "fam", "times"])


def _family_links(batches):
    """Links inside a block, or between two blocks, of a family: as many as connect what is connected."""
    for _, rows in rows_by_key(batches):
        rows.sort(key=lambda r: r[0])
        sid, n = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        toks = [np.frombuffer(r[2], U8) for r in rows]
        _, col = np.unique(np.concatenate(toks), return_inverse=True)
        row = np.repeat(np.arange(len(rows)), [len(t) for t in toks])
        both, wide = np.zeros((len(rows), len(rows)), np.float32), 8192
        order = np.argsort(col, kind="stable")
        cuts = np.searchsorted(col[order], np.arange(0, int(col.max()) + wide + 1, wide))
        for k in range(len(cuts) - 1):
            o = order[cuts[k] : cuts[k + 1]]
            has = np.zeros((len(rows), wide), np.float32)
            has[row[o], col[o] - k * wide] = 1
            both += has @ has.T
        both = both.astype(np.int64)
        alike = 100 * both >= 80 * (n[:, None] + n[None, :] - both)
        left, a, b = np.ones(len(rows), bool), [], []
        for i in range(len(rows)):
            if not left[i]:
                continue
            left[i], front = False, np.array([i])
            while len(front):
                front = np.flatnonzero(alike[front].any(axis=0) & left)
                left[front] = False
                a.extend([sid[i]] * len(front))
                b.extend(sid[front])
        yield _pairs(np.array(a, np.int64), np.array(b, np.int64))


def _cross_pairs(batches):
    """All pairs of a token's group that lie in different components and pass length and position."""
    for sid, n, comp, fam, place, cuts in _groups(batches):
        found = []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if hi - lo < 2 or (comp[lo:hi] == comp[lo]).all():
                continue
            for i in range(lo, hi - 1):
                j = slice(i + 1, hi)
                need = (4 * (n[i] + n[j]) + 8) // 9  # least intersection: 0.8 / 1.8 of both sizes
                rest = np.minimum(n[i] - place[i], n[j] - place[j])  # holds at the first token they share
                ok = np.flatnonzero((comp[j] != comp[i]) & (fam[j] != fam[i]) & _alike(n[i], n[j]) & (rest >= need)) + i + 1
                if len(ok):
                    found.append(np.stack([np.full(len(ok), sid[i]), sid[ok]]))
        if found:
            got = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
            yield _pairs(got[0], got[1])


def _linked(batches):
    """Verifies (a, b, na, nb, toks, classes of both): first the other orders, then the intersection."""
    for batch in batches:
        a, b, na, nb, ta, tb, ca, cb = (c.to_pylist() for c in batch.columns)
        keep = []
        for k in range(len(a)):
            x, y = np.frombuffer(ta[k], U8), np.frombuffer(tb[k], U8)
            u, v = np.frombuffer(ca[k], U1), np.frombuffer(cb[k], U1)
            qa, qb = int(_prefix(np.int64(na[k]), np.int64(len(x)))), int(_prefix(np.int64(nb[k]), np.int64(len(y))))
            for seed in ORDERS:  # a further global order: the class of the count first, then a seeded hash
                px = x[np.lexsort((mix(x ^ np.uint64(seed)), u))[:qa]]
                py = y[np.lexsort((mix(y ^ np.uint64(seed)), v))[:qb]]
                if not np.isin(px, py, kind="sort").any():
                    break
            else:
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= 80 * (na[k] + nb[k] - both):
                    keep.append(k)
        yield _pairs(np.array([a[k] for k in keep], np.int64), np.array([b[k] for k in keep], np.int64))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    side = lambda s: sets.select(*(F.col(c).alias(c + s if c != "sid" else s) for c in ("sid", "n", "toks", "cls")))
    full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "toksa", "toksb", "clsa", "clsb")
    return full.mapInArrow(_linked, "a long, b long")


def _documents(batches):
    """(id, size, set id) of each text."""
    for t, i in _chunks(batches, CHUNK * 6):
        size, sid, _ = shingle_sets(t)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(size), pa.array(sid.view(np.int64))], ["id", "n_shingles", "sid"])


def set_links(docs: DataFrame, text: str = "text") -> DataFrame:
    """(sid, component) of every set that links with another one; see the module's text."""
    p = width(bounded(docs).sparkSession)
    runs = docs.select(text).mapInArrow(lean(_token_runs(p)), "bucket int, run binary")
    shared = dealt(runs, "bucket").mapInArrow(lean(_shared_tokens(p)), "grp int, run binary")
    sets = stage(dealt(shared, "grp").mapInArrow(lean(_surviving_sets), "sid long, n int, toks binary, cls binary"), "sets")
    post = lambda df: dealt(df.mapInArrow(lean(_postings(p)), "bucket int, run binary"), "bucket")
    alone = sets.select("sid", "n", "toks", F.col("sid").alias("comp"), F.col("sid").alias("fam"))
    met = post(alone).mapInArrow(_hubs, "sid long, fam long, times long").groupBy("sid", "fam").agg(F.sum("times").alias("times"))
    own = met.groupBy("sid").agg(F.max_by("fam", F.struct("times", "fam")).alias("fam"))
    family = stage(sets.join(own, "sid", "left").select("sid", "n", "toks", F.coalesce("fam", "sid").alias("fam")), "family")

    # all members of a family meet in blocks: block i with block j, for every two blocks
    sizes = family.groupBy("fam").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    cut = family.join(sizes, "fam").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("block", F.expr("cast(pmod(xxhash64(sid), blocks) as int)"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.xxhash64("fam", F.least("block", "other"), F.greatest("block", "other"))
    inside = stage(dealt(met.select(key.alias("key"), "sid", "n", "toks"), "key").mapInArrow(lean(_family_links), "a long, b long"), "links")
    labels = components(inside)

    # what lies in other families: pairs by any prefix token, unless they are connected already
    known = family.join(labels.withColumnRenamed("id", "sid"), "sid", "left").select("sid", "n", "toks", F.coalesce("component", "sid").alias("comp"), "fam")
    pairs = post(known).mapInArrow(lean(_cross_pairs), "a long, b long").distinct()
    across = stage(_verified(pairs, sets), "links")
    release(labels, family)
    links = [inside, across]
    labels = components(inside.unionByName(across))
    release(sets, *links)
    return labels.select(F.col("id").alias("sid"), "component")


def jaccard_components(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id, set_id) of every row of docs.

    component_id is the smallest key that is reachable over links, the row's own included. Null and
    empty texts, and texts without words, have no set and link with nothing: their component is
    their own key. Equal sets always link. Rows may repeat; a null key never names a component.
    Set ids and tokens are 64-bit hashes: two different sets of N share an id with probability
    N^2 / 2^65. Columns of docs other than text and key are not looked at.
    """
    labels = set_links(docs, text)
    own = stage(docs.select(F.col(text), F.col(key).cast("long")).mapInArrow(lean(_documents), "id long, n_shingles long, sid long"), "own")
    full = own.where("n_shingles > 0")
    sets = full.groupBy("sid").agg(F.min("id").alias("first"))
    named = sets.join(labels, "sid", "left").select("sid", "first", F.coalesce("component", "sid").alias("component"))
    named = stage(named, "named")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of_set = named.join(least, "component").select("sid", "component_id")
    linked = full.join(of_set, "sid").select("id", "n_shingles", "component_id", "sid")
    alone = own.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"), F.lit(None).cast("long").alias("sid"))
    return linked.unionByName(alone).select(F.col("id").alias(key), "n_shingles", "component_id", F.col("sid").alias("set_id"))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without near copies: of each component, the row of the smallest key stays, all columns kept.

    Rows without words or with a null key stay.
    """
    gone = jaccard_components(docs, text, key).where(f"`{key}` <> component_id").select(key)
    return docs.join(gone, key, "left_anti").select(*docs.columns)
