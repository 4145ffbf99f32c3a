"""How much text a task of the n-gram join holds at once."""

import numpy as np
import pyarrow as pa

from quern.llm import ngram_join


def _batches():
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 5000, 4000))) for _ in range(300)]
    return pa.Table.from_pydict({"text": texts + texts[:5]}).to_batches(50)


def _sets(runs):
    found = {}
    for batch in runs:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for sid, n, tok in zip(*(x.tolist() for x in ngram_join._read_token_runs([blob])), strict=True):
                found.setdefault((bucket, sid, n), set()).add(tok)
    return found


def test_a_task_holds_little_text_at_once(monkeypatch):
    held, known = [], ngram_join.shingle_sets
    monkeypatch.setattr(ngram_join, "shingle_sets", lambda column: held.append(sum(map(len, column))) or known(column))
    got = _sets(ngram_join._token_runs(4)(iter(_batches())))
    assert sum(held) > 5_000_000 and max(held) < 1_500_000
    monkeypatch.setattr(ngram_join, "CHUNK", 2_000_000)
    assert got == _sets(ngram_join._token_runs(4)(iter(_batches())))
