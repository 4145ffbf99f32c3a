"""Names of a dictionary against a plain search of words."""

import random
import re

import pytest

from quern.operators import dictionary

ORDER = ["DISASTER", "PROGRAM"]
NAMES = [("PROGRAM", "local buyout program"), ("DISASTER", "Ike"), ("DISASTER", "hurricane ike"), ("TX_COUNTY", "fort bend county"), ("TX_COUNTY", "county of bee"), ("TX_COUNTY", "bee"), ("PROGRAM", "bend county local"), ("ORG", "bee"), ("ORG", "Bee"), ("PROGRAM", "..."), ("PROGRAM", None), (None, "ike"), ("ORG", "é_1")]


def plain(text, settle):
    words = list(re.finditer(r"\w+", text))
    found = []
    for kind, name in {x for x in NAMES if None not in x}:
        w = re.findall(r"\w+", name.lower())
        for i in range(len(words) - len(w) + 1 if w else 0):
            if [x.group().lower() for x in words[i : i + len(w)]] == w:
                found.append((ORDER.index(kind) if kind in ORDER else len(ORDER), words[i].start(), words[i + len(w) - 1].end(), kind, name))
    if not settle:
        return found
    kept = []
    for m in sorted(found, key=lambda m: (m[0], m[1] - m[2], m[1], m[3], m[4])):
        if all(m[2] <= k[1] or k[2] <= m[1] for k in kept):
            kept.append(m)
    return kept


@pytest.mark.parametrize("settle, most", [(True, 200_000), (False, 200_000), (True, 3), (False, 3)])
def test_mentions(spark, settle, most):
    r = random.Random(8)
    pieces = ["hurricane", "Ike", "fort", "Bend", "county", "local", "buyout", "program", "of", "BEE", "bees", "é_1", "x", "İstanbul"]
    rows = [(i % 50, "".join(r.choice(pieces) + r.choice([" ", ", ", "-", "\n"]) for _ in range(r.randint(0, 60))), "t", 1) for i in range(60)] + [(None, "Ike", "t", 1), (99, None, "t", 1), (98, "", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, type string, row int").repartition(3)
    got = dictionary.mentions(docs, spark.createDataFrame(NAMES, "type string, name string"), ORDER, settle=settle, most=most).collect()
    want = [(k, a, b, kind, name, t[a:b]) for k, t, *_ in rows if t for _, a, b, kind, name in plain(t, settle)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(want) > 100


def test_no_names(spark):
    docs = spark.createDataFrame([(1, "ike")], "doc_id long, text string")
    assert dictionary.mentions(docs, spark.createDataFrame([], "type string, name string"), ORDER).collect() == []
