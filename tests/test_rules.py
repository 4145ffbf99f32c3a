"""Each rule of report lines on its stated forms, one by one."""

from collections import Counter

import pytest

from quern.plans import rules


@pytest.mark.parametrize("name", sorted(rules.CASES))
def test_rule(spark, name):
    given, expected, cases, make = rules.CASES[name]
    names, n = rules.columns(given + ", " + expected), len(rules.columns(given))
    rows = spark.createDataFrame(list(dict.fromkeys(c[:n] for c in cases)), given)
    got = make(rows).selectExpr(*[f"CAST(`{c}` AS {kind})" for c, kind in names]).collect()
    assert Counter(map(tuple, got)) == Counter(cases)
