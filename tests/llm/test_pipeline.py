"""The pipeline's stages in order, each on all that its predecessor kept."""

import corpus_pipeline
from quern.llm import decontaminate, line_dedup, ngram_join, toxicity

DATA = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "decontamination", "packing"]
    now = docs
    for _, step in corpus_pipeline.STAGES[:-1]:
        now = step(spark, now, DATA).cache()
        assert now.columns == columns
    packed = corpus_pipeline.STAGES[-1][1](spark, now, DATA)
    want = {(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packed.collect()}
    got = corpus_pipeline.run(spark, DATA)
    assert {(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in got.collect()} == want
    assert 0 < now.count() < docs.count()


def test_stages_decide(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    toxic = {r["doc_id"] for r in toxicity.scores(docs, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in toxicity.without_toxic(docs, labels).collect()} == {r["doc_id"] for r in docs.collect()} - toxic
    whole = {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_lines(docs).collect()}
    assert len(whole) == docs.count()
    left = {r["doc_id"] for r in corpus_pipeline.lines(spark, docs, DATA).collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert left == {i for i, t in whole.items() if t.split() or not before[i].split()} and len(left) < len(whole)
    assert ngram_join.one_of_each(docs).count() == ngram_join.jaccard_components(docs).select("component_id").distinct().count()
    assert decontaminate.clean_of(docs, bench).count() == decontaminate.judged(docs, bench).where("not contaminated").count()
