"""Words of topics are cut once for all that reads them."""

import re

from pyspark.sql import functions as F

from quern.operators import topics


def test_weights_read_lists_of_terms(spark):
    rows = [(1, "red fox red fox", "a"), (2, "fox", "a"), (3, None, "b"), (4, "dog red", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, topic string")
    found = topics.topic_terms(docs, "topic")
    assert {r["topic"]: r["size"] for r in found.collect()} == {"a": 2, "b": 1, None: 1}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "regexp_extract_all" in docs.select(topics.words(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_whole_runs(spark):
    texts = ["The cat-nap a_b abc_ _abc x9 ab abc9 Über uber 𝐀abc abc𝐀 abc😀 (fox)", "-abc abc- a--b the-end", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(topics.words(F.col("t"))).collect()]
    runs = [re.findall(r"[\w-]+", (t or "").lower()) for t in texts]
    assert got == [[w for w in own if re.fullmatch("[a-z][a-z0-9-]{2,}", w) and w not in topics.STOP] for own in runs]
