"""Exact top-k by inner product with a pivot-distance index.

Vectors are quantised to integers, floor(256 * x). An inner product orders as a distance does once
each vector x gets one more component, sqrt(M - |x|^2), with M the largest squared norm, and each
query a zero there: |q - x'|^2 = |q|^2 + M - 2 <q, x>. The index keys every vector by its nearest
pivot and its distance to it; a block holds a run of one pivot's vectors in the order of distance, an
annulus. No vector of a block whose distances to the pivot lie in [lo, hi] is nearer to q than the gap
between d(q, pivot) and that interval, by the triangle inequality.

Each query first visits its home, the block with the smallest gap; the k-th score found there is its
mark. Then it goes to every block whose bound reaches the mark, and to no other, and inside a block
through finer annuli from the nearest outwards, until the bound rules out the rest. The blocks'
intervals are all that is sent to the queries: at most MOST_BLOCKS of them, as blocks grow with the
table. Integer scores are exact, ties go to the smaller vec_id, and bounds are widened against rounding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import dealt, release, rows_by_key, stage

SCALE, PIVOTS = 256, 64
#: Vectors of a block (more, if there would be more than MOST_BLOCKS of them), of an annulus inside it, and of
#: a group of queries.
BLOCK, ANNULUS, GROUP, MOST_BLOCKS = 4096, 256, 4096, 1 << 16
EPS = 1e-6


def quantised(batches):
    """(vec_id, integer components as float64 bytes, squared norm); rows that take no part are left out."""
    for batch in batches:
        ids, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out = []
        for i, v in zip(ids, rows, strict=True):
            if v is None or i is None or any(x is None for x in v):
                continue
            x = np.array(v, np.float64)
            if np.isfinite(x).all():
                q = np.floor(SCALE * x)
                out.append((i, len(q), q.tobytes(), float(q @ q)))
        cols = list(zip(*out, strict=True)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.float64())], ["vec_id", "dim", "vec", "norm"])


def _matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.c_[x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))]


def _keyed(pivots: np.ndarray, most: float):
    """(vec_id, vec, pivot, radius): the nearest pivot of each vector."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            blobs = batch.column(1).to_pylist()
            d = _distance(_lifted(_matrix(blobs), most), pivots)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary()), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])], ["vec_id", "vec", "pivot", "radius"])

    return run


def _bound(qq: np.ndarray, most: float, gap: np.ndarray) -> np.ndarray:
    """The most that a score can be beyond a gap: <q, x> <= (|q|^2 + M - gap^2) / 2, and a little more."""
    return (qq + most - gap**2) / 2 + EPS * (qq + most + gap**2) + EPS


def _sent(pivots: np.ndarray, most: float, blocks: np.ndarray, home: bool):
    """(block, query row) for the blocks that a query visits: its home, or all that its mark does not rule out.
    blocks: rows of block, pivot, lo, hi."""
    names, of, lo, hi = (blocks[f] for f in ("block", "pivot", "lo", "hi"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column(1).to_pylist())
            mark = batch.column(3).to_numpy(zero_copy_only=False)
            d = _distance(np.c_[q, np.zeros(len(q))], pivots)
            qq = (q * q).sum(1)
            step = max(1, (1 << 16) // len(names))  # rows that are made at once
            for a in range(0, len(q), step):
                part = slice(a, a + step)
                own = d[part][:, of]
                gap = np.maximum(np.maximum(lo - own, own - hi), 0)
                if home:
                    who, which = np.arange(len(own)), gap.argmin(1)
                else:
                    who, which = np.nonzero(_bound(qq[part, None], most, gap) >= mark[part, None])
                yield pa.RecordBatch.from_arrays([pa.array(names[which]), *(c.take(pa.array(a + who)) for c in batch.columns[:3])], ["block", "vec_id", "vec", "times"])

    return run


def _search(pivots: np.ndarray, most: float, k: int):
    """Per meeting of a block with a group of queries: the k best rows for each query, and how often it asks."""

    def run(batches):
        for _, rows in rows_by_key(batches):
            data = sorted((r for r in rows if not r[0]), key=lambda r: (r[4], r[1]))
            asked = [r for r in rows if r[0]]
            if not data or not asked:
                continue
            x, ids, radius = _matrix([r[2] for r in data]), np.array([r[1] for r in data]), np.array([r[4] for r in data])
            q, qids, times = _matrix([r[2] for r in asked]), np.array([r[1] for r in asked]), np.array([r[5] for r in asked], np.int32)
            pivot = pivots[data[0][3]][None, :]
            dq = _distance(np.c_[q, np.zeros(len(q))], pivot)[:, 0]
            qq = (q * q).sum(1)
            best = np.full((len(q), k), -np.inf)
            owner = np.full((len(q), k), np.iinfo(np.int64).max)
            cuts = [*range(0, len(data), ANNULUS), len(data)]
            lo, hi = radius[cuts[:-1]], radius[np.array(cuts[1:]) - 1]
            gap = np.maximum(np.maximum(lo[None, :] - dq[:, None], dq[:, None] - hi[None, :]), 0)
            order = np.argsort(gap, axis=1, kind="stable")
            going = np.ones(len(q), bool)
            for turn in range(len(lo)):
                ring = order[:, turn]
                going &= _bound(qq, most, gap[np.arange(len(q)), ring]) >= best[:, -1]
                if not going.any():
                    break
                for r in np.unique(ring[going]):
                    who = np.flatnonzero(going & (ring == r))
                    part = slice(cuts[r], cuts[r + 1])
                    score = q[who] @ x[part].T
                    score[qids[who][:, None] == ids[part][None, :]] = -np.inf
                    s = np.concatenate([best[who], score], axis=1)
                    o = np.concatenate([owner[who], np.broadcast_to(ids[part], score.shape)], axis=1)
                    top = np.lexsort((o, -s), axis=1)[:, :k]
                    best[who], owner[who] = np.take_along_axis(s, top, 1), np.take_along_axis(o, top, 1)
            ok = np.isfinite(best)
            n = ok.sum(1)
            asker = pa.array([r[2] for r in asked], pa.binary()).take(pa.array(np.repeat(np.arange(len(q)), n)))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, n)), asker, pa.array(owner[ok]), pa.array(best[ok].astype(np.int64)), pa.array(np.repeat(times, n))], ["query_id", "vec", "vec_id", "score", "times"])

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every row whose key is divisible by `every`.

    Rows with a null key, a null vector, or a null or non-finite component take no part; vectors of
    different lengths never meet; an empty table gives no row. A repeated key stands for rows of one
    owner: none of them answers its own query; in other answers each counts, and so does each that asks:
    the rows of a key that asks rank their pairs together. Other columns are not looked at.
    """
    each = vectors.select(F.col(key).cast("long"), vector).mapInArrow(quantised, "vec_id long, dim int, vec binary, norm double")
    # of equal rows no more than k can be among the k best
    rows = stage(each.groupBy("vec_id", "dim", "vec", "norm").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("times")), "quantised")
    out = None
    for (dim,) in rows.select("dim").distinct().orderBy("dim").collect():  # nearly always one
        found = _of_dimension(rows.where(F.col("dim") == dim), k, every)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _of_dimension(rows: DataFrame, k: int, every: int) -> DataFrame:
    n, most = rows.agg(F.count(F.lit(1)), F.max("norm")).first()
    drawn = rows.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec").limit(PIVOTS).select("vec").collect()
    pivots = _lifted(_matrix([r["vec"] for r in drawn]), most)
    copies = rows.select("vec_id", "vec", F.explode(F.sequence(F.lit(1), "times"))).select("vec_id", "vec")
    keyed = stage(copies.mapInArrow(_keyed(pivots, most), "vec_id long, vec binary, pivot int, radius double"), "keyed")
    # cut each pivot's distances into blocks of about `size` vectors: at most PIVOTS * 200 marks go to the driver
    size = max(BLOCK, -(-n // MOST_BLOCKS))
    share = keyed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"))
    wanted = F.greatest(F.ceil(F.col("n") / size).cast("int"), F.lit(1))
    edges = keyed.join(F.broadcast(share), "pivot").groupBy("pivot").agg(F.first(wanted).alias("parts"), F.percentile_approx("radius", [i / 200 for i in range(1, 201)], 10000).alias("marks"))
    marked = keyed.join(F.broadcast(edges), "pivot")  # PIVOTS rows
    rank = F.size(F.filter("marks", lambda m: m < F.col("radius")))
    # inside a mark, where many radii are equal, vectors go to sub-blocks by hash: no block outgrows its share
    block = F.xxhash64("pivot", F.floor(rank * F.col("parts") / 200), F.when(F.col("parts") > 200, F.pmod(F.xxhash64("vec_id", "vec"), F.ceil(F.col("parts") / 200))).otherwise(F.lit(0)))
    blocks = stage(marked.select("vec_id", "vec", "pivot", "radius", block.alias("block")), "blocks")
    release(keyed)
    kept = blocks.groupBy("block", "pivot").agg(F.min("radius").alias("lo"), F.max("radius").alias("hi")).collect()  # MOST_BLOCKS rows and one a pivot and mark
    table = np.array([(r["block"], r["pivot"], r["lo"], r["hi"]) for r in sorted(kept)], [("block", "<i8"), ("pivot", "<i8"), ("lo", "<f8"), ("hi", "<f8")])
    groups = max(1, -(-n // (every * GROUP)))
    ask = rows.where(F.col("vec_id") % every == 0).select("vec_id", "vec", "times")

    def found(asking: DataFrame, home: bool) -> DataFrame:
        sent = asking.mapInArrow(_sent(pivots, most, table, home), "block long, vec_id long, vec binary, times int")
        sent = sent.withColumn("grp", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(groups)).cast("int"))
        key = F.xxhash64("block", "grp").alias("key")
        asked = sent.select(key, F.lit(True).alias("asked"), "vec_id", "vec", F.lit(0).alias("pivot"), F.lit(0.0).alias("radius"), "times")
        # a block is copied once for each group of queries: rows in blocks, not pairs
        given = blocks.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(key, F.lit(False).alias("asked"), "vec_id", "vec", "pivot", "radius", F.lit(1).alias("times"))
        return dealt(given.unionByName(asked), "key").mapInArrow(_search(pivots, most, k), "query_id long, vec binary, vec_id long, score long, times int")

    marks = found(ask.withColumn("mark", F.lit(0.0)), True).groupBy(F.col("query_id").alias("vec_id"), "vec").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("mark"))
    asking = stage(ask.join(marks, ["vec_id", "vec"], "left").select("vec_id", "vec", "times", F.coalesce(F.col("mark").cast("double"), F.lit(float("-inf"))).alias("mark")), "marks")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    pairs = found(asking, False).select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), "times"))).drop("col")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
