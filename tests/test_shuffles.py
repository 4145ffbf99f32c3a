"""What is shuffled of words and of vectors."""

import re

from quern.operators import vectors


def test_terms_are_counted_in_place(spark):
    docs = spark.createDataFrame([(1, "red red fox"), (1, "red"), (2, "fox"), (3, None), (None, "fox")], "doc_id long, text string")
    found = vectors.term_weights(docs)
    assert sorted((tuple(r)[:4] for r in found.collect()), key=str) == sorted([(1, "red", 3, 1), (1, "fox", 1, 3), (2, "fox", 1, 3), (None, "fox", 1, 3)], key=str)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(doc_id#\d+L, \d", plan) and not re.search(r"hashpartitioning\(doc_id#\d+L, term", plan)
    assert not any("Filter" in line and "regexp_extract_all" in line for line in plan.splitlines())
