"""Null, repeated and clashing rows, empty tables and very long texts: every operator and every pipeline stage."""

import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline
from quern.llm import decontaminate, line_dedup, ngram_join, packing, substring_dedup, toxicity, warc, wrapper

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ROWS = [
    (1, LONG, "en", "s", 5, "e", "b", 1), (1, LONG, "en", "s", 5, "e", "b", 1), (2, LONG + " tail", "en", "s", 5, "e", "b", 1), (3, None, None, None, None, None, None, None), (4, "", "", "", 0, "", "", 0),
    (None, "some words that stand here alone", "en", "s", 1, "e", "b", 1), (None, None, None, None, None, None, None, None), (5, " \n \n", "x", "y", 4, "e", "b", 2), (6, "one two\none two", "x", "y", 4, "e", "b", 2),
]
#: Names that operators use inside stand beside the documents' own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, first string, row int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(2)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables of labels and benchmark items with nulls and repeats."""
    at = tmp_path_factory.mktemp("edges")
    spark.createDataFrame([(1, 0, 0), (1, 0, 0), (2, 1, None), (None, 1, 1), (6, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "absent item text"), (1, None), (None, "words nobody has"), (2, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def key(x):
    return (x is not None, x or 0)


def test_ngram_join(docs):
    got = ngram_join.jaccard_components(docs).collect()
    assert len(got) == len(ROWS)
    want = Counter([(1, 1)] * 2 + [(2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (None, None), (None, None)])
    assert Counter((x["doc_id"], x["component_id"]) for x in got) == want
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] for r in kept.collect()), key=key) == [None, None, 1, 1, 3, 4, 5, 6]


def test_line_dedup(docs):
    kept = line_dedup.without_repeated_lines(docs)
    assert kept.columns == docs.columns
    got = {(r["doc_id"], r["text"]) for r in kept.collect()}
    # rows 1 and 1 are one document; row 2's line is near row 1's
    assert got == {(1, LONG), (2, ""), (3, None), (4, ""), (None, "some words that stand here alone"), (None, None), (5, " \n \n"), (6, "one two")}


def test_substring_dedup(docs):
    got = Counter((x["doc_id"], x["n_words"], x["n_removed"]) for x in substring_dedup.repeats_removed(docs).collect())
    assert got == Counter([(1, 30_000, 30_000)] * 2 + [(2, 30_001, 30_000), (3, 0, 0), (4, 0, 0), (5, 0, 0), (6, 4, 0), (None, 6, 0), (None, 0, 0)])


def test_packing(docs):
    got = packing.pack(docs).collect()
    assert sorted(x["sequence_id"] for x in got) == list(range(len(got)))
    tokens = Counter((x["doc_id"], x["doc_tokens"]) for x in got if x["start"] == 0)
    assert sum(tokens.values()) == len(ROWS) and sum(x["length"] for x in got) == sum(n * k for (_, n), k in tokens.items())
    assert tokens[3, 1] == tokens[4, 1] == 1 and tokens[None, 1] == 1


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1), (2, 1), (4, 1)], [(None, 1), (1, None)]])
def test_toxicity_of_one_class(spark, docs, labels):
    marked = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.scores(docs, marked).collect()
    assert len(got) == len(ROWS) and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in got)
    assert all(x["held_out"] is False for x in got if x["doc_id"] is None)
    assert toxicity.without_toxic(docs, marked).columns == docs.columns


def test_toxicity_risk():
    """The risk that is learned falls below that of a scorer that knows nothing."""
    import numpy as np

    r = np.random.default_rng(0)
    toxic = [np.unique(np.r_[r.integers(10, 400, 12), r.integers(0, 4, 2)]).astype(np.int32) for _ in range(200)]
    other = [np.unique(r.integers(10, 400, 14)).astype(np.int32) for _ in range(900)] + toxic[100:]
    prior = 0.1
    found = toxicity.train(toxic[:100], other, prior)
    score = lambda rows: np.array([1 / (1 + np.exp(-(found.bias + sum(w for i, w in zip(found.ids, found.weights, strict=True) if i in set(d.tolist()))))) for d in rows])
    risk = lambda p, u: prior * (1 - p).mean() + max(0.0, u.mean() - prior * p.mean())  # noqa: E731  l(z) = 1 / (1 + exp(z))
    learned = risk(score(toxic[:100]), score(other))
    assert learned < min(risk(np.full(100, c), np.full(len(other), c)) for c in (0.01, 0.1, 0.5)) * 0.7


def test_warc(spark):
    rows = [(2, "http://a.b/1", "<p>same</p>"), (2, "http://a.b/1", "<p>same</p>"), (1, None, "<p>same</p>"), (3, "u", None), (4, "u", ""), (None, "u", "<p>x</p>"), (5, "u", "é" * 300_000)]
    df = spark.createDataFrame([(*r, "a", 1, None) for r in rows], "page_id long, url string, html string, entries string, size int, first string")
    got = warc.page_records(df).collect()
    assert len(got) == len(rows)
    assert {(x["page_id"], x["record_type"], x["refers_to"]) for x in got if x["page_id"] in (1, 5)} == {(1, "response", None), (5, "response", None)}
    assert {x["payload_bytes"] for x in got if x["page_id"] == 5} == {600_000} and {x["payload_bytes"] for x in got if x["page_id"] in (3, 4)} == {0}
    assert warc.page_records(df.limit(0)).count() == 0


def test_html(spark):
    page = "<html><body><article><h1>T</h1><p>a  b</p></article></body></html>"
    rows = [(1, "http://h.x/1", page), (1, "http://h.x/1", page), (2, None, page), (None, "http://h.x/2", page), (3, "http://h.x/3", None), (4, "http://h.x/4", ""), (5, "http://h.x/5", "<p>" * 5000 + "deep")]
    df = spark.createDataFrame([(*r, "z", "z", "z") for r in rows], "page_id long, url string, html string, host string, ref string, wrapper string")
    got = wrapper.main_texts(df).collect()
    assert Counter((x["page_id"], x["text"]) for x in got) == Counter({(1, "T\n\na b"): 2, (2, "T\n\na b"): 1, (None, "T\n\na b"): 1, (3, ""): 1, (4, ""): 1, (5, "deep"): 1})
    assert all(x["n_chars"] == len(x["text"]) for x in got) and wrapper.main_texts(df.limit(0)).count() == 0


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, "stand here alone"), (1, "stand here alone")], "item_id long, text string")
    got = Counter((x["doc_id"], x["n_hit"], x["n_items"], x["items_sha256"], x["contaminated"]) for x in decontaminate.judged(docs, bench).collect())
    none, one = (hashlib.sha256(x).hexdigest() for x in (b"", b"1"))
    kept = decontaminate.clean_of(docs, bench)
    assert kept.columns == docs.columns and Counter(x["doc_id"] for x in kept.collect()) == Counter([1, 1, 2, 3, 4, 5, 6, None])
    assert got[None, 3, 1, one, True] == 1 and got[None, 0, 0, none, False] == 1 and got[1, 0, 0, none, False] == 2


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_pipeline_stage(spark, docs, folder, name):
    """Nulls, empty and very long texts, repeated rows, extra columns, no rows at all."""
    step = dict(corpus_pipeline.STAGES)[name]
    got = step(spark, docs, folder)
    if name != "packing":
        assert got.columns == docs.columns
        clean = {r["doc_id"] for r in got.collect()}
        assert {3, 4, 5, 6, None} <= clean and 1 in clean
    else:
        assert {r["doc_id"] for r in got.collect()} == {1, 2, 3, 4, 5, 6, None}
    assert step(spark, docs.limit(0), folder).count() == 0


def test_pipeline_against_plain_steps(spark, folder, tmp_path):
    """The whole run on documents whose fate is known: toxic ones, copies, near copies, benchmark passages."""
    r = random.Random(2)
    words = [f"v{i}" for i in range(30_000)]
    text = lambda n=60: " ".join(r.choice(words) for _ in range(n))
    item = text(40)
    rows, fate = [], {}
    for i in range(400):
        bad = i % 4 == 1
        rows.append((i, text() + (" vile scum filth vermin" if bad else ""), "en", "s", 1))
        fate[i] = "toxic" if bad else "kept"
    marks = [(i, 0, int(fate[i] == "toxic")) for i in range(400)]
    base = rows[0][1]
    near = base.split()
    near[30] = "other"
    for i, t, f in ((500, base, "copy"), (501, "new line\n" + base, "shorter"), (502, item + " x", "benchmark"), (503, text(), "kept")):
        rows.append((i, t, "en", "s", 1))
        fate[i] = f
    at = str(tmp_path / "tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    left = {x["doc_id"] for x in corpus_pipeline.run(spark, at).collect()}
    assert {i for i in left if fate[i] in ("copy", "benchmark")} == set()
    assert sum(fate[i] == "toxic" for i in left) <= 5
    assert {i for i, f in fate.items() if f in ("kept", "shorter")} - left == set()


def test_toxicity_cut():
    """The cut is of least counted risk over every way to part the values, the highest of several such."""
    import numpy as np

    r = np.random.default_rng(3)
    for _ in range(60):
        p, u = r.integers(0, 9, r.integers(1, 12)).astype(float), r.integers(0, 9, r.integers(1, 30)).astype(float)
        prior = float(r.uniform(0.02, 0.6))
        risk = {c: prior * np.mean(p < c) + max(0.0, np.mean(u >= c) - prior * np.mean(p >= c)) for c in (*np.unique(np.r_[p, u]), 99.0)}
        least = max(c for c in risk if risk[c] < min(risk.values()) + 1e-12)
        found = toxicity.cut(p, u, prior)
        assert all((v >= found) == (v >= least) for v in (*p, *u))
    assert toxicity.cut(np.zeros(3), np.zeros(9), 0.1) > 0
