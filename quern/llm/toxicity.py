"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; the unlabelled ones are a draw of all documents, the
positives among them, for a missing or a "clean" label does not prove that a text is clean and the
prior speaks of documents as they come. A linear scorer over hashed words and beginnings of words
minimises

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]),   l(z) = 1 / (1 + exp(z)),

the class-prior-corrected risk whose negative part is not let below zero: where a step finds it
below, it climbs back instead. The prior is the share of toxic rows among the labelled ones of the
training fold. The bias is then moved so that a score of 0.5 lies where the same risk, counted in
whole documents, is least (`cut`). Rows whose crc32(doc_id as text) mod 5 is 0 are held out of all
of this. Fitted is only what stands among the positives more often than chance puts it there, and at
most one feature for three positives, or rare words would tell the positives of the fit one by one
and leave the toxic words without weight.

At most POSITIVES and about UNLABELLED documents are drawn for the fit, by a hash of the doc_id:
the fit's cost does not grow with the corpus. Their features are hashed and counted in tasks; to the
driver go the counts of those that enough positives hold, and of a drawn document the fitted features
only. Scoring covers every document and moves none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quern.llm.common import ALNUM, bounded, lean, release, stage, texts

POSITIVES, UNLABELLED = 4_000, 16_000
#: Hashes of features, the least number of positives that hold one, and the most that are fitted.
SPACE, LEAST, FEATURES = 1 << 22, 3, 4096
#: Bytes of the beginnings of longer words, which inflected forms of one stem share.
STEMS = (4, 5, 6, 7, 8)
#: How many words and beginnings may pass as standing out among the positives by chance alone.
CHANCE = 1
STEPS, RATE, DECAY = 400, 0.05, 1e-3


def held_out(key):
    """The test fold. A null key is in neither fold's favour: it is not held out, and never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def forms(word: bytes) -> list[bytes]:
    """A word, and its beginnings if it is longer (marked, a beginning is no word)."""
    return [word, *(word[:k] + b"-" for k in STEMS if len(word) > k)]


def features(text: bytes | None) -> set[bytes]:
    return {f for w in set((text or b"").translate(ALNUM).split()) for f in forms(w)}


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) % SPACE


def _hashed(batches):
    for batch in batches:
        ids = [np.unique(np.fromiter(map(_hash, features(t)), np.int32)).astype("<i4").tobytes() for t in texts(batch.column(0))]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(ids, pa.binary())], ["positive", "drawn", "ids"])


def counted(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features, sorted, with the number of positives and of unlabelled documents that hold each."""
    none = [np.empty(0, np.int32)]
    ids, at = np.unique(np.concatenate(none + positive + unlabelled), return_inverse=True)
    own = sum(map(len, positive))
    return ids, np.bincount(at[:own], minlength=len(ids)), np.bincount(at[own:], minlength=len(ids))


def _counted(batches):
    for batch in batches:
        own, drawn, ids = (c.to_pylist() for c in batch.columns)
        of = lambda kind: [np.frombuffer(d, "<i4") for d, k in zip(ids, kind, strict=True) if k]  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in counted(of(own), of(drawn))], ["id", "p", "u"])


def _restricted(chosen: np.ndarray):
    """worded (whether the document has a feature at all), and of its features the chosen ones."""

    def run(batches):
        for batch in batches:
            docs = [np.frombuffer(d, "<i4") for d in batch.column(2).to_pylist()]
            ids = pa.array([d[np.isin(d, chosen)].tobytes() for d in docs], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([len(d) > 0 for d in docs], pa.bool_()), ids], ["positive", "drawn", "worded", "ids"])

    return run


class Scorer:
    """Weights of hashed words and a bias; score(texts) lies in 0..1."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, bias: float):
        self.ids, self.weights, self.bias = ids, weights, bias

    def score(self, column: list[bytes | None]) -> np.ndarray:
        by_hash = dict(zip(self.ids.tolist(), self.weights.tolist(), strict=True))
        known: dict[bytes, tuple[int, ...]] = {}  # the features that a word gives
        out = np.empty(len(column))
        for k, t in enumerate(column):
            found: set[int] = set()
            for w in set((t or b"").translate(ALNUM).split()):
                if (v := known.get(w)) is None:
                    if len(known) > 300_000:
                        known.clear()
                    v = known[w] = tuple(i for i in map(_hash, forms(w)) if i in by_hash)
                if v:
                    found.update(v)
            out[k] = self.bias + sum(by_hash[i] for i in sorted(found))
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def cut(gp: np.ndarray, gu: np.ndarray, prior: float) -> float:
    """The value from which documents are called toxic: where prior * missed + max(0, called - prior * caught) is least,
    the highest of several, between two values that occur; above all of them if calling none is best."""
    at = np.unique(np.r_[gp, gu])
    caught = np.r_[1 - np.searchsorted(np.sort(gp), at) / len(gp), 0.0]
    called = np.r_[1 - np.searchsorted(np.sort(gu), at) / len(gu), 0.0]
    risk = prior * (1 - caught) + np.maximum(0, called - prior * caught)
    k = int(np.flatnonzero(risk <= risk.min() + 1e-12)[-1])
    edges = np.r_[at[0] - 1, at, at[-1] + 1]
    return float(edges[k] + edges[k + 1]) / 2


def fitted(ids: np.ndarray, p_df: np.ndarray, u_df: np.ndarray, n_positive: int, n_unlabelled: int) -> np.ndarray:
    """The features to fit, sorted: what stands out among the positives; p_df and u_df count the documents that hold each."""
    often = p_df >= LEAST
    ids, p_df, u_df = ids[often], p_df[often], u_df[often]
    # occurrences of chance would lie among the positives so often with a probability of at most exp(-odds)
    share, held = n_positive / (n_positive + n_unlabelled), p_df / (p_df + u_df)
    odds = (p_df + u_df) * (held * np.log(held / share) + (1 - held) * np.log(np.maximum(1 - held, 1e-300) / (1 - share)))
    good = np.flatnonzero((held > share) & (odds > np.log(max(1, len(ids)) / CHANCE)))
    return ids[np.sort(good[np.argsort(-odds[good], kind="stable")[: min(FEATURES, max(16, n_positive // 3))]])]


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Scorer:
    """Fits the scorer to whole documents; without a word of a positive, or without unlabelled texts, every score is the prior."""
    ids, p_df, u_df = counted(positive, unlabelled)
    worded = bool(p_df.any())
    return weighed(fitted(ids, p_df, u_df, len(positive), len(unlabelled)) if worded and unlabelled else ids[:0], positive, unlabelled, prior, worded)


def weighed(ids: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, worded: bool) -> Scorer:
    """Fits weights of the features ids, whatever others the documents hold; worded: whether a positive has a feature at all."""
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    if not worded or not unlabelled:
        return Scorer(np.empty(0, np.int32), np.empty(0), float(np.log(prior / (1 - prior))))

    def rows(docs):
        at = [np.searchsorted(ids, d) for d in docs]
        at = [a[(a < len(ids)) & (ids[np.minimum(a, len(ids) - 1)] == d)] if len(ids) else a[:0] for a, d in zip(at, docs, strict=True)]
        return np.repeat(np.arange(len(docs)), [len(a) for a in at]), np.concatenate(at)

    (pr, pc), (ur, uc) = rows(positive), rows(unlabelled)
    w, b = np.zeros(len(ids)), -1.0
    m, v = np.zeros(len(ids) + 1), np.zeros(len(ids) + 1)
    for step in range(1, STEPS + 1):
        gp = np.bincount(pr, w[pc], len(positive)) + b
        gu = np.bincount(ur, w[uc], len(unlabelled)) + b
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        slope_p, slope_u = sp * (1 - sp) / len(positive), su * (1 - su) / len(unlabelled)
        grad = lambda s, r, c, n: np.r_[np.bincount(c, s[r], len(ids)), s.sum()]
        d_p, d_u = grad(slope_p, pr, pc, None), grad(slope_u, ur, uc, None)
        negative = su.mean() - prior * sp.mean()  # l(-g) = sigmoid(g)
        g = -prior * d_p + (d_u - prior * d_p) if negative >= 0 else -(d_u - prior * d_p)
        g = g + DECAY * np.r_[w, 0] / max(1, len(ids)) ** 0.5
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    return Scorer(ids, w, b)


def centred(scorer: Scorer, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Scorer:
    """The scorer with its bias moved so that 0.5 is at the cut; itself where there is nothing to cut by."""
    if not positive or not unlabelled or not len(scorer.ids):
        return scorer
    by_hash = dict(zip(scorer.ids.tolist(), scorer.weights.tolist(), strict=True))
    value = lambda docs: np.array([scorer.bias + sum(by_hash.get(i, 0.0) for i in d.tolist()) for d in docs])
    return Scorer(scorer.ids, scorer.weights, scorer.bias - cut(value(positive), value(unlabelled), prior))


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Learns from docs (doc_id, text) and labels (doc_id, toxic). Nulls, repeated labels (any toxic
    one counts) and labels of absent documents are allowed; an empty table leaves the prior."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = marked.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") > 0).cast("int")), F.lit(0))).first()
    prior = toxic / n if n else 0.01
    draw = lambda want, of: F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 30)) < F.lit(int(min(1.0, want / max(of, 1)) * (1 << 30)))
    positive = marked.where((F.col("toxic") > 0) & draw(POSITIVES, toxic)).select("doc_id", F.lit(True).alias("positive"))
    total = bounded(docs).select("doc_id").count()
    own = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    # POSITIVES ids at most go to every executor
    known = own.join(F.broadcast(positive), "doc_id", "left")
    drawn = known.select("text", F.coalesce("positive", F.lit(False)).alias("positive"), draw(UNLABELLED, total).alias("drawn")).where("positive OR drawn")
    hashed = stage(drawn.mapInArrow(lean(_hashed), "positive boolean, drawn boolean, ids binary"), "drawn")
    n_p, n_u = hashed.agg(F.count_if("positive"), F.count_if("drawn")).first()
    often = hashed.mapInArrow(lean(_counted), "id int, p int, u int").groupBy("id").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where(F.col("p") >= LEAST)
    ids, p_df, u_df = (c.to_numpy() for c in often.toArrow().sort_by("id").columns)
    chosen = fitted(ids, p_df, u_df, n_p, n_u) if n_p and n_u else ids[:0]
    rows = hashed.mapInArrow(lean(_restricted(chosen)), "positive boolean, drawn boolean, worded boolean, ids binary").collect()
    release(hashed)
    rows.sort(key=lambda r: (r["positive"], r["drawn"], bytes(r["ids"])))  # whatever order tasks end in
    of = lambda kind: [np.frombuffer(r["ids"], "<i4") for r in rows if r[kind]]
    own, drawn = of("positive"), of("drawn")
    return centred(weighed(chosen, own, drawn, prior, any(r["positive"] and r["worded"] for r in rows)), own, drawn, prior)


def _scored(scorer: Scorer):
    def run(batches):
        for batch in batches:
            score = scorer.score(texts(batch.column(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*batch.schema.names[1:], "score", "predicted"])

    return run


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs; null and empty texts get the bias's score."""
    scorer = fit(docs, labels)
    return docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out")).mapInArrow(lean(_scored(scorer)), "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs whose score stays below one half, all columns kept: a filter on the scan, nothing is moved."""
    scorer = fit(docs, labels)
    names = docs.columns
    schema = StructType([StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema.fields)])
    own = names.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(scorer.score(texts(batch.column(own))) < 0.5))

    return docs.toDF(*schema.names).mapInArrow(lean(run), schema).toDF(*names)
