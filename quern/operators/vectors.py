"""Vectors and term weights. Sums run in double."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import graphs, neighbours
from quern.operators.stages import cut


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows of the largest cosine to one query; ties to the smaller key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, F.round(cosine(F.col(vector), q), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def nearest_to_row(vectors: DataFrame, row: int, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    one = vectors.where(F.col(key) == row).select(F.col(vector).alias("_q"))
    scored = vectors.join(F.broadcast(one), F.lit(True)).select(key, F.round(cosine(F.col(vector), F.col("_q")), 6).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


#: Seeds that are sent to every task; with more of them the rows meet them in blocks of seeds.
SEEDS = 1024


def best_seed(vectors: DataFrame, seeds: DataFrame, threshold: float, k: int, head_first: bool = False, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The largest cosine over seed vectors (seed, embedding) and the seed that has it; rows of at least
    the threshold, k at most. head_first takes the k best before the threshold is applied.

    Seeds are broadcast in blocks of at most SEEDS, and the best of each block compete."""
    own = seeds.select("seed", F.col(vector).alias("_s"))
    parts = -(-own.count() // SEEDS)
    best = None
    for part in range(max(parts, 1)):
        block = own if parts <= 1 else own.where(F.pmod(F.xxhash64("seed"), F.lit(parts)) == part)
        scored = vectors.join(F.broadcast(block), F.lit(True)).select(key, "seed", F.round(cosine(F.col(vector), F.col("_s")), 6).alias("score"))
        scored = scored.groupBy(key).agg(F.max("score").alias("score"), F.min_by("seed", F.struct(-F.col("score"), F.col("seed"))).alias("seed"))
        best = scored if best is None else best.unionByName(scored)
    if parts > 1:
        best = best.groupBy(key).agg(F.max("score").alias("score"), F.min_by("seed", F.struct(-F.col("score"), F.col("seed"))).alias("seed"))
    order = (F.desc("score"), key)
    if head_first:
        return best.orderBy(*order).limit(k).where(F.col("score") >= threshold)
    return best.where(F.col("score") >= threshold).orderBy(*order).limit(k)


def term_weights(docs: DataFrame, key: str = "doc_id", text: str = "text", pattern: str = "[a-z]{3,}") -> DataFrame:
    """key, term, tf, df, tfidf: smoothed inverse document frequency, ln((1 + n) / (1 + df)) + 1.

    Documents are dealt by key as a row each, so their terms are counted where they are and not shuffled for it."""
    found = docs.select(key, F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"({pattern})"), F.lit(1)).alias("terms")).repartition(key)
    # outer, as for a plain explode the optimizer would filter by the list, and so make it three times
    terms = found.select(key, F.explode_outer("terms").alias("term")).where("term IS NOT NULL")
    tf = terms.groupBy(key, "term").agg(F.count(F.lit(1)).cast("bigint").alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).cast("bigint").alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("_n"))
    return tf.join(df, "term").join(F.broadcast(n), F.lit(True)).select(key, "term", "tf", "df", F.round(F.col("tf") * (F.log((1.0 + F.col("_n")) / (1.0 + F.col("df"))) + 1.0), 6).alias("tfidf"))


def top_terms(weights: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("tfidf"), "term"))
    return weights.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k).select(key, "rank", "term", "tfidf")


def clusters(vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", seed: int = 42) -> DataFrame:
    """key, cluster, score = 1 / (1 + distance to the centre): k-means of the ML library."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(key, F.col(vector), array_to_vector(vector).alias("features"))
    model = KMeans(k=k, seed=seed).fit(rows)
    centres = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>")
    found = model.transform(rows).select(key, vector, F.col("prediction").alias("cluster")).join(F.broadcast(centres), "cluster")
    gap = F.zip_with(vector, "centre", lambda x, y: x.cast("double") - y)
    return found.select(key, "cluster", (1 / (1 + F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)))).alias("score"))


#: Rows of a component that one task groups at once.
AT_ONCE = 20_000


def settled_groups(ranked: DataFrame, threshold: float = 0.92, block: str = "label", key: str = "vec_id", vector: str = "embedding", score: str = "score", at_once: int = AT_ONCE) -> DataFrame:
    """block, key, founder, place: inside a block, rows in the order of score (nulls last, ties by key) join the group
    whose running centroid is nearest, if its cosine is at least the threshold, else they found one. Of equally near
    groups the oldest wins; place is the row's place in that order within its component.

    A centroid of rows that each joined at the threshold or above is at least threshold long, so a row that joins has a
    member within threshold squared of it. Rows that no chain of such neighbours connects never share a group. So
    components of that neighbourhood are grouped apart from each other, each in its order, `at_once` rows in a round,
    with the sums of its groups carried from round to round. Without a usable vector a row founds a group of its own.

    What one task holds are `at_once` rows and the groups of one component. Keys are longs and distinct."""
    at = neighbours.cells(ranked, key, vector)
    links = graphs.components(neighbours.links_within(at, float(np.sqrt(2 - 2 * threshold * threshold)) + 1e-8))
    rows = ranked.select(F.col(block).alias("block"), F.col(key).alias("key"), neighbours.as_numbers(ranked, vector).alias("v"), F.col(score).cast("double").alias("score"))
    rows = rows.join(links.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    order = Window.partitionBy("block", "component").orderBy(F.desc_nulls_last("score"), "key")
    rows = cut(rows.withColumn("place", F.row_number().over(order) - 1).withColumn("round", F.expr(f"place div {at_once}")))
    rounds = rows.agg(F.max("round")).first()[0]
    kind = dict(rows.dtypes)["block"]
    schema = f"block {kind}, component long, key long, founder long, place int, s array<double>, n int"

    def settle(_, new: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        new, groups = new.sort_values("place"), groups.sort_values("place")
        size = len(new) + len(groups)
        width = max((len(v) for v in [*new["v"], *groups["s"]] if v is not None), default=1)
        sums, norms, founders, places = np.zeros((size, width)), np.ones(size), list(groups["founder"]), list(groups["place"])
        n = len(groups)
        if n:
            sums[:n] = groups["s"].tolist()
            norms[:n] = np.linalg.norm(sums[:n], axis=1)
        out = []
        for k, v, place in zip(new["key"], new["v"], new["place"], strict=True):
            x = None if v is None else np.array(v, float)
            usable = x is not None and np.isfinite(x).all() and np.linalg.norm(x) > 0
            if usable:
                x /= np.linalg.norm(x)
                near = sums[:n] @ x / norms[:n]
                best = int(near.argmax()) if n else -1
                if best >= 0 and near[best] >= threshold:
                    sums[best] += x
                    norms[best] = np.linalg.norm(sums[best]) or 1
                    out.append((k, founders[best], place))
                    continue
                sums[n], norms[n] = x, 1
                n += 1
                founders.append(k)
                places.append(place)
            out.append((k, k, place))
        where = (new if len(new) else groups)[["block", "component"]].iloc[0]
        rows_ = [(where["block"], where["component"], k, f, p, None, 0) for k, f, p in out] + [(where["block"], where["component"], None, f, p, s.tolist(), 1) for f, p, s in zip(founders, places, sums[:n], strict=True)]
        return pd.DataFrame(rows_, columns=["block", "component", "key", "founder", "place", "s", "n"]).astype({"key": "Int64"})

    done, groups = None, ranked.sparkSession.createDataFrame([], schema)
    for r in range(-1 if rounds is None else rounds + 1):
        now = rows.where(F.col("round") == r)
        old = groups.join(now.select("block", "component").distinct(), ["block", "component"], "left_semi")
        both = cut(now.groupBy("block", "component").cogroup(old.groupBy("block", "component")).applyInPandas(settle, schema))
        groups, found = both.where("n = 1"), both.where("n = 0")
        done = found if done is None else done.union(found)
    done = groups.where("false") if done is None else done
    return done.select(F.col("block").alias(block), F.col("key").alias(key), "founder", "place")


def greedy_groups(ranked: DataFrame, threshold: float = 0.92, block: str = "label", key: str = "vec_id", vector: str = "embedding", score: str = "score") -> DataFrame:
    """block, key, grp: settled_groups, and a block's groups numbered in the order of their founders."""
    found = settled_groups(ranked, threshold, block, key, vector, score)
    first = found.join(ranked.select(F.col(key), F.col(score).alias("_s")), key).where(F.col(key) == F.col("founder"))
    number = F.row_number().over(Window.partitionBy(block).orderBy(F.desc_nulls_last("_s"), "founder")) - 1
    return found.join(first.select("founder", number.alias("grp")), "founder").select(block, key, "grp")


def chunks(docs: DataFrame, size: int, overlap: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(T.chunk_words(F.col(text), size, overlap)).alias("chunk", "chunk_text"))
