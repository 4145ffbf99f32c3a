"""A worker hands mentions on in pieces, whatever a batch of texts holds."""

import pandas as pd
import pytest

from quern.operators import dictionary


@pytest.mark.parametrize("settle", [True, False])
def test_pieces(spark, monkeypatch, settle):
    kind, runs = type(spark.range(1)), []
    own = kind.mapInPandas
    monkeypatch.setattr(kind, "mapInPandas", lambda self, run, schema: runs.append(run) or own(self, run, schema))
    docs = spark.createDataFrame([(1, "ike")], "doc_id long, text string")
    dictionary.mentions(docs, spark.createDataFrame([("DISASTER", "ike")], "type string, name string"), ["DISASTER"], settle=settle)
    texts = ["ike " * 7000, None, "", "ike " * 7000]
    frames = list(runs[0](iter([pd.DataFrame({"doc_id": range(4), "row": range(4), "text": texts})])))
    assert sum(map(len, frames)) == 14000 and max(map(len, frames)) <= dictionary.AT_ONCE == 5000
    assert sorted(zip(*[pd.concat(frames)[c] for c in ("doc_id", "start")], strict=True)) == [(k, 4 * i) for k in (0, 3) for i in range(7000)]
