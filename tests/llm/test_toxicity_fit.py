"""What the toxicity scorer learns where many rare words stand among the positives by chance, and of stems."""

import numpy as np

from quern.llm import toxicity

N_WORDS, LENGTH = 400_000, 150


def _draw(n, rng, toxic):
    """Hashed texts of rare words; toxic ones have one of ten words that no other text has."""
    docs = [rng.integers(100, N_WORDS, LENGTH) for _ in range(n)]
    return [np.unique(np.r_[d, rng.integers(0, 10, 1)] if toxic else d).astype(np.int32) for d in docs]


def test_words_of_chance_do_not_hide_the_toxic_ones():
    rng = np.random.default_rng(5)
    found = toxicity.train(_draw(2000, rng, True), _draw(7200, rng, False) + _draw(800, rng, True), 0.1)
    weights = dict(zip(found.ids.tolist(), found.weights.tolist(), strict=True))
    assert all(weights.get(k, 0.0) > 0 for k in range(10))
    assert len(found.ids) <= 2000 // 3
    value = lambda docs: np.array([sum(weights.get(i, 0.0) for i in d.tolist()) for d in docs])
    toxic, clean = value(_draw(300, rng, True)), value(_draw(300, rng, False))
    assert np.mean(toxic > np.quantile(clean, 0.95)) > 0.95


def test_forms_of_one_stem_meet():
    assert {b"Vequart".lower(), b"vequa-"} <= toxicity.features(b"Vequart")
    assert toxicity.features(b"vequart") & toxicity.features(b"vequall")
    assert toxicity.features(b"one") == {b"one"} and toxicity.features(None) == set()


def test_the_driver_gets_fitted_features_only(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(5)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got, known = {}, toxicity.centred
    monkeypatch.setattr(toxicity, "centred", lambda scorer, own, drawn, prior: got.update(own=own, drawn=drawn, prior=prior) or known(scorer, own, drawn, prior))
    found = toxicity.fit(docs, labels)
    fitted = set(found.ids.tolist())
    assert fitted and got["own"] and got["drawn"]
    assert all(fitted.issuperset(d.tolist()) for d in got["own"] + got["drawn"])
    # as one fit of the whole documents
    ids = {r["doc_id"]: np.unique([toxicity._hash(f) for f in toxicity.features((r["text"] or "").encode())]).astype(np.int32) for r in docs.where(~toxicity.held_out("doc_id")).collect()}
    marked = {r["doc_id"] for r in labels.where("toxic > 0").collect()}
    own = [ids[k] for k in sorted(ids.keys() & marked)]
    assert len(own) == len(got["own"]) and len(ids) == len(got["drawn"])
    whole = known(toxicity.train(own, list(ids.values()), got["prior"]), own, list(ids.values()), got["prior"])
    assert np.array_equal(whole.ids, found.ids) and np.allclose(whole.weights, found.weights) and np.isclose(whole.bias, found.bias)
