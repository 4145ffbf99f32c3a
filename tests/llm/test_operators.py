"""Each operator against a plain version on small tables, with nulls, empty and long texts, ties,
repeated rows, empty tables and extra columns of clashing names."""

import base64
import gzip
import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import chunk_store, common, decontaminate, line_dedup, ngram_join, packing, substring_dedup, tokens, topk, toxicity, warc, wrapper

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, sid string, n int"


def corpus(seed=1, n=60):
    """Texts with exact and near copies, shared lines and passages, nulls, empty and short ones."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["The", "of", "É,", "a.b", "x!"]
    line = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    hot, passage = line(12), line(60)
    rows = []
    for i in range(n):
        text = "\n".join([line(r.randint(1, 60)) for _ in range(r.randint(1, 5))] + ([hot] if i % 3 == 0 else []) + ([passage] if i % 4 == 0 else []))
        rows.append(text)
    for i in range(0, n, 5):
        rows.append(rows[i])
        w = rows[i].split(" ")
        w[len(w) // 2] = "changed"
        rows.append(" ".join(w))
    rows += [None, "", "   ", "one", "one", "One two three", "one two three", line(5000), "w1 " * 300]
    return [(i * 3 % 1009, t, "en", "s", len(t or ""), i, "x", 0) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def shingles(text, n=5):
    w = [x.translate(LOWER) for x in words(text)]
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def components_of(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    least = {i: i for i in sets}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                least[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}, sets


def test_ngram_join(spark, docs, rows, nothing):
    want, sets = components_of(rows)
    got = ngram_join.jaccard_components(docs).collect()
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in got} == {i: (want[i], len(sets[i])) for i in want}
    assert any(i != c for i, c in want.items())
    assert ngram_join.jaccard_components(nothing).count() == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(want.values())


def test_ngram_join_of_near_copies(spark):
    """A group of near copies: chains of links, more sets than one hub reaches."""
    r = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"n{r.random()}"
        rows.append((i, " ".join(w)))
    want, _ = components_of(rows)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == want


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 440)]
    least = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = {x["id"]: x["component"] for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in least.items() if any(k in e and e[0] != e[1] for e in edges)}


def removed_lines(rows):
    seen, gone, post = [], set(), defaultdict(set)
    for i, t in sorted((i, t) for i, t, *_ in rows if t is not None):
        for k, line in enumerate(t.split("\n")):
            w = [x for x in re.split("[ \t\n\x0b\f\r]+", line.lower()) if x]
            if not w:
                continue
            s = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))
            near = {c for x in s for c in post[x]}
            if any(100 * len(s & seen[c]) >= 80 * len(s | seen[c]) for c in near):
                gone.add((i, k))
            for x in s:
                post[x].add(len(seen))
            seen.append(s)
    return gone


def test_line_dedup(docs, rows, nothing):
    want = removed_lines(rows)
    got = line_dedup.line_decisions(docs).collect()
    assert {(r["doc_id"], k) for r in got for k in r["removed"]} == want
    assert len(got) == len(rows)
    assert all(r["n_removed"] == len(r["removed"]) for r in got)
    kept = {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_lines(docs).collect()}
    for i, t, *_ in rows:
        assert kept[i] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in want))
    assert line_dedup.line_decisions(nothing).count() == 0
    plan = docs.sparkSession._jvm.PythonSQLUtils.explainString(line_dedup.line_decisions(docs)._jdf.queryExecution(), "simple")
    assert not re.search("Python|Pandas|Arrow", plan)


def test_line_dedup_of_a_family(spark):
    """One line in most rows, near copies of it in many, a chain whose ends do not match, tabs and null ids."""
    r = random.Random(8)
    base = [f"k{i}" for i in range(100)]
    rows = [(i, " ".join(base)) for i in range(0, 300, 3)]
    for i in range(1, 240, 3):
        w = list(base)
        w[r.randrange(100)] = f"n{i}"
        rows.append((i, " ".join(w) + ("\n" + " ".join(base) if i % 2 else "")))
    for k in range(6):  # each is near the one before it
        rows.append((1000 + k, "\t".join(base[:2] + [f"c{j}" for j in range(5 * k)] + [f"d{j}" for j in range(5 * k, 60)])))
    rows = [(i, t, "en", "s", 0, 0, "x", 0) for i, t in rows]
    got = line_dedup.line_decisions(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {(x["doc_id"], k) for x in got for k in x["removed"]} == removed_lines(rows)
    rows = [(None, "one line\n \none line"), (4, "one  LINE"), (4, "one  LINE"), (5, None), (6, "")]
    got = line_dedup.line_decisions(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x["doc_id"] or -1, x["n_lines"], x["removed"]) for x in got) == [(-1, 3, [0, 2]), (4, 1, []), (4, 1, []), (5, 0, []), (6, 1, [])]


def without_repeats(rows):
    count = Counter(tuple(w[i : i + 35]) for w in (words(t) for _, t, *_ in rows) for i in range(len(w) - 34))
    out = {}
    for i, t, *_ in rows:
        w = words(t)
        gone = {k for j in range(len(w) - 34) if count[tuple(w[j : j + 35])] > 1 for k in range(j, j + 35)}
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_substring_dedup(docs, rows, nothing):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.repeats_removed(docs).collect()}
    want = without_repeats(rows)
    assert got == {i: (a, b, hashlib.sha256(k).hexdigest()) for i, (a, b, k) in want.items()}
    assert sum(b for _, b, _ in want.values()) > 300
    assert substring_dedup.repeats_removed(nothing).count() == 0


def test_substring_dedup_of_repeated_rows(spark):
    text = " ".join(f"u{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (None, "short"), (None, None)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in substring_dedup.repeats_removed(df).collect()) == [0, 0, 40, 40]


def test_fingerprint_index(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(50))
    batches = [[(1, f"a b {passage}"), (2, "x y z")], [(3, f"{passage} c"), (4, "new " * 3)], [(5, f"q {passage}")]]
    index = substring_dedup.FingerprintIndex(spark, f"file://{tmp_path}/index")
    kept = []
    for k, rows in enumerate(batches):
        kept.append({r["doc_id"]: r["text"] for r in index.add(spark.createDataFrame(rows, "doc_id long, text string")).collect()})
        if k == 1:
            assert len(index.generations) == 2
            assert len(index.compact().generations) == 1
    assert kept == [{1: f"a b {passage}", 2: "x y z"}, {3: "c", 4: "new " * 3}, {5: "q"}]


def test_warc(spark, tmp_path):
    r = random.Random(3)
    html = [None, "", "<p>é</p>", "a\r\n\r\nWARC/1.1 b", "x" * 300_000] + [f"page {r.randrange(12)}" for _ in range(40)]
    rows = [(i, f"http://h/{i}", h, "d") for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    first = {}
    for i, _, h, _ in rows:
        first.setdefault(h or "", i)
    want = {i: (len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, _, h, _ in rows}
    raw = warc.written(pages)
    members = warc.normalised(raw)
    got = {x["page_id"]: (x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in warc.read(members).collect()}
    assert got == want
    for a, b in zip(raw.orderBy("archive").collect(), members.orderBy("archive").collect(), strict=True):
        assert gzip.decompress(a["data"]) == gzip.decompress(b["data"])  # the same records, in the same order
        assert [e["offset"] for e in b["entries"]] == list(np.cumsum([0] + [e["length"] for e in b["entries"]])[:-1])
    names = warc.export(members, str(tmp_path))
    with gzip.open(names[0]) as f:
        assert list(warc.parse(io.BufferedReader(f)))
    assert warc.page_records(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def hits(rows, items, window=13):
    found = defaultdict(set)
    cut = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOWER))
    for i, t in items:
        w = cut(t)
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            found[tuple(w[k : k + m])].add(i)
    out = {}
    for i, t, *_ in rows:
        w, hit, of = cut(t), set(), set()
        for m in {len(x) for x in found}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in found:
                    hit.update(range(k, k + m))
                    of |= found[tuple(w[k : k + m])]
        out[i] = (len(w), len(hit), sorted(map(str, of)))
    return out


def test_decontamination(spark, docs, rows, nothing):
    r = random.Random(4)
    items = [(k, " ".join((t or "").split()[3 : 3 + r.randint(5, 40)])) for k, (_, t, *_) in enumerate(rows) if k % 6 == 0] + [(900, "one"), (901, None), (902, ""), (903, "one two three"), (904, "absent words " * 9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = hits(rows, items)
    got = decontaminate.judged(docs, bench).collect()
    for x in got:
        n, h, of = want[x["doc_id"]]
        assert (x["n_words"], x["n_hit"], x["n_items"], x["items_sha256"]) == (n, h, len(of), hashlib.sha256(",".join(of).encode()).hexdigest())
        assert x["contaminated"] == (h > 0 and 20 * h >= n)
    assert len(got) == len(rows)
    assert decontaminate.judged(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.judged(nothing, bench).count() == 0
    assert {x["doc_id"] for x in decontaminate.clean_of(docs, bench).collect()} == {i for i, (n, h, _) in want.items() if not (h and 20 * h >= n)}


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_decontamination_of_repeated_items(spark, docs, rows, monkeypatch, block):
    """Rows of one item are one item, null ids hit without a name; any number of blocks gives the same."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    items = [(k // 3, " ".join((t or "").split()[2 : 2 + 9 + k])) for k, (_, t, *_) in enumerate(rows) if k % 4 == 0] + [(1, "one two three"), (1, "one two three"), (None, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    joined = defaultdict(dict)
    for i, t in items:
        for x, (n, h, of) in hits(rows, [(i, t)]).items():
            if of and i is not None:
                joined[x][str(i)] = 1
    hit = {x: h for x, (n, h, _) in hits(rows, [(k, t) for k, (_, t) in enumerate(items)]).items()}
    for x in decontaminate.judged(docs.unionByName(docs.where("doc_id < 50")), bench).collect():
        of = sorted(joined[x["doc_id"]])
        assert (x["n_hit"], x["n_items"], x["items_sha256"]) == (hit[x["doc_id"]], len(of), hashlib.sha256(",".join(of).encode()).hexdigest())


def test_fm_index():
    r = np.random.default_rng(0)
    for _ in range(30):
        seq = np.r_[r.integers(1, 4, r.integers(1, 200)), 0]  # one barrier: no two rotations are equal
        index = decontaminate.FmIndex(seq, 4)
        for m in (1, 2, 3, 5):
            patterns = r.integers(1, 4, (20, m))
            lo, hi = index.search(patterns, m)
            for p, a, b in zip(patterns, lo, hi, strict=True):
                want = [k for k in range(len(seq) - m + 1) if (seq[k : k + m] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_top_k(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 8))
    x[10], x[20] = x[0], x[0]  # ties
    rows = [(i, [float(v) for v in np.round(x[i], 3)], 0) for i in range(600)] + [(700, None, 0), (750, [None] + [0.0] * 7, 0), (800, [float("nan")] * 8, 0), (850, [float("inf")] * 8, 0), (None, [1.0] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(3)
    q = np.floor(256 * np.round(x, 3))
    got = defaultdict(list)
    for y in topk.top_k(df).orderBy("query_id", "rank").collect():
        got[y["query_id"]].append((y["vec_id"], y["score"]))
    assert sorted(got) == list(range(0, 600, 50))
    for i, found in got.items():
        s = q @ q[i]
        order = [int(k) for k in np.lexsort((np.arange(600), -s)) if k != i][:5]
        assert found == [(k, int(s[k])) for k in order]
    assert topk.top_k(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [0.5])], "vec_id long, embedding array<double>")
    assert [tuple(y) for y in topk.top_k(few).collect()] == [(0, 1, 1, 256 * 128)]


def test_top_k_of_repeated_rows(spark):
    """Repeated candidates, a hot key with many vectors and repeated asking rows, as the registered SQL has them."""
    import duckdb
    import pandas as pd

    from quern.llm.queries import ORACLES

    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(120, 4)), 3)
    rows = [(i, x[i].tolist()) for i in range(120)] + [(7, (2 * x[0]).tolist())] * 9 + [(8, (1.9 * x[0]).tolist())] * 3 + [(50, x[50].tolist())] * 2 + [(100, x[3].tolist())]
    rows += [(9, np.round(v, 3).tolist()) for v in r.normal(size=(40, 4))]
    r.shuffle(rows)
    rows = [(int(i), list(map(float, v))) for i, v in rows]
    con = duckdb.connect()
    con.register("embeddings", pd.DataFrame(rows, columns=["vec_id", "embedding"]))
    want = con.sql(ORACLES["op6_exact_top_k"]).fetchall()
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert [y["vec_id"] for y in sorted(got) if y["query_id"] == 0] == [7] * 5


@lru_cache
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_vocabulary())
    return t


def ids_of(text):
    t = tokenizer()
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def test_token_codec():
    r = random.Random(3)
    alphabet = "abzÉé×÷ßñ.,'!?sS tT\n\t́  　x1٣漢…😀İſ\x1c\x00-_&"
    column = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(2000)]
    column += ["don't!! it's <|endoftext|>.", " x<|endoftext|>y ", "<|ENDOFTEXT|> <|startoftext|", None, "", " \n", "é" * 3000, "word " * 9000]
    got, n = tokens.codec(tokens.default_vocabulary()).encode(pa.array(column).slice(0))
    assert got.tolist() == [int(i) for t in column for i in ids_of(t)]
    assert n.tolist() == [len(ids_of(t)) for t in column]
    part, n = tokens.codec(tokens.default_vocabulary()).encode(pa.array(column).slice(500, 300))
    assert part.tolist() == [int(i) for t in column[500:800] for i in ids_of(t)]


def test_token_codec_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 400)
    own, r = tokens.WordCodec(tokens.default_vocabulary()), random.Random(4)
    for _ in range(30):
        column = [" ".join("".join(r.choice("abcdé.,") for _ in range(r.randint(1, 4))) for _ in range(30)) for _ in range(4)]
        assert own.encode(pa.array(column))[0].tolist() == [int(i) for t in column for i in ids_of(t)]


def test_token_codec_of_another_kind():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    column = ["Two  words.", None, "", "a<|endoftext|>b\n\n"]
    want = [[*Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, 1] for t in column]
    got, n = tokens.codec(path).encode(pa.array(column))
    assert got.tolist() == sum(want, []) and n.tolist() == [len(x) for x in want]


def test_packing(docs, rows, nothing):
    got = defaultdict(list)
    seen = set()
    for p in packing.pack(docs, with_ids=True).collect():
        got[p["doc_id"]].append(p)
        assert p["offset"] == 0 and p["length"] & (p["length"] - 1) == 0 and p["length"] <= 2048
        assert p["sequence_id"] not in seen
        seen.add(p["sequence_id"])
    assert seen == set(range(len(seen)))
    for i, t, *_ in rows:
        ids, at = ids_of(t), 0
        for p in sorted(got[i], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"], p["ids"]) == (at, len(ids), ids[at : at + p["length"]].tobytes())
            assert p["ids_crc32"] == zlib.crc32(p["ids"])
            at += p["length"]
        assert at == len(ids)
    assert packing.pack(nothing).count() == 0


def test_token_store(spark, docs, rows, nothing, tmp_path):
    store = chunk_store.stored(docs)
    start = 0
    got = {x["doc_id"]: x for x in store.read_back().collect()}
    for i, t in sorted((i, t) for i, t, *_ in rows):
        ids = ids_of(t)
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    names = [bytes(r["name"]) for r in store.packs.collect()]
    assert len(names) == len(set(names))
    assert {bytes(r["digests"][k : k + 32]) for r in store.recipes.collect() for k in range(0, len(r["digests"]), 32)} == set(names)
    assert store.manifest.agg(F.sum("docs"), F.sum("tokens")).first() == (len(rows), start)
    assert chunk_store.stored(nothing).read_back().count() == 0


@pytest.mark.parametrize("wrong", ["nothing", "digests", "root", "doc_id", "lost", "manifest"])
def test_token_store_with_a_wrong_recipe(spark, docs, tmp_path, wrong):
    import pyarrow.parquet as pq

    store = chunk_store.ChunkStore(spark, f"file://{tmp_path}/store").write(docs)
    folder = "manifest" if wrong == "manifest" else "recipes"
    column = "root" if wrong == "manifest" else wrong
    for path in sorted((tmp_path / "store" / folder).glob("*.parquet")) if wrong != "nothing" else ():
        held = pq.read_table(path)
        rows = held.to_pylist()
        k = next((k for k, x in enumerate(rows) if folder == "manifest" or len(x["digests"]) >= 64), None)
        if k is not None:
            break
    if wrong != "nothing":
        x = rows[k]
        if wrong == "lost":
            del rows[k]
        else:
            x[column] = 10**9 if column == "doc_id" else x[column][32:64] + x[column][:32] + x[column][64:] if column == "digests" else bytes(32)
        pq.write_table(pa.Table.from_pylist(rows, held.schema), path)
        (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    if wrong == "nothing":
        assert store.read_back().count() == docs.count()
    else:
        with pytest.raises(Exception, match="differ"):
            store.read_back().collect()
    if wrong == "digests":  # no root says so: the recipes themselves do
        store._verify_manifest = lambda: None
        with pytest.raises(Exception, match="a recipe and its chunks differ"):
            store.read_back().collect()


def test_token_store_with_a_wrong_pack(spark, docs, tmp_path):
    import pyarrow.parquet as pq

    store = chunk_store.ChunkStore(spark, f"file://{tmp_path}/store").write(docs)
    path = max((tmp_path / "store" / "packs").glob("*.parquet"), key=lambda p: pq.read_metadata(p).num_rows)
    held = pq.read_table(path)
    for change, says in ((lambda x: x | {"data": x["data"][:-2] + b"zz"}, "the bytes that its name says"), (lambda x: x | {"name": bytes(32)}, "chunks are missing")):
        pq.write_table(pa.Table.from_pylist([change(x) for x in held.to_pylist()], held.schema), path)
        (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
        with pytest.raises(Exception, match=says):
            store.read_back().collect()


def test_chunks():
    """Cuts depend on a document's own ids alone, and no chunk has more than MOST of them."""
    r = np.random.default_rng(5)
    docs = [r.integers(0, 900, n).astype(np.uint32) for n in (1, 7, 8, 9, 5000, 3)] + [np.zeros(20_000, np.uint32), np.ones(1, np.uint32)]
    counts = np.array([len(d) for d in docs])
    gear = chunk_store._gear(1000)
    ends, own = chunk_store.chunk_ends(np.concatenate(docs), counts, gear).tolist(), []
    for d, at in zip(docs, np.cumsum(counts) - counts, strict=True):
        own += (at + chunk_store.chunk_ends(d, np.array([len(d)]), gear)).tolist()
    assert ends == own
    assert max(np.diff([0, *ends])) == chunk_store.MOST and set(np.cumsum(counts)) <= set(ends)


def test_token_store_of_equal_documents(spark):
    """Null and repeated ids, one text in most rows, and one of many ids in one chunk."""
    rows = [(None, "same text"), (5, "same text"), (5, "other"), (5, None)] + [(i, "same text") for i in range(400)] + [(7, "a " * 20_000)]
    got = sorted(chunk_store.stored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).read_back().collect(), key=lambda x: x["start"])
    assert len(got) == len(rows)
    at = 0
    for x in got:
        assert x["start"] == at
        at += x["n_tokens"]
    want = Counter((i, len(ids_of(t)), zlib.crc32(ids_of(t).tobytes())) for i, t in rows)
    assert Counter((x["doc_id"], x["n_tokens"], x["ids_crc32"]) for x in got) == want
    assert [x["doc_id"] for x in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))


def test_toxicity(spark):
    r = random.Random(7)
    bad = ["vile1", "vile2", "vile3", "vile4"]
    rows, marks = [], []
    for i in range(1500):
        w = [f"w{min(int(r.expovariate(0.01)), 900)}" for _ in range(60)]
        toxic = i % 9 == 0
        if toxic:
            for _ in range(4):
                w[r.randrange(60)] = r.choice(bad)
        rows.append((i, " ".join(w), "en"))
        if i % 2 == 0:
            marks.append((i, 1, int(toxic)))
    rows += [(2000, None, "en"), (2001, "", "en"), (None, "vile1 vile2 vile3", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([*marks, (None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in toxicity.scores(docs, labels).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(1500))
    right = sum(got[i]["predicted"] == int(i % 9 == 0) for i in range(1500) if got[i]["held_out"])
    assert right >= 0.98 * sum(got[i]["held_out"] for i in range(1500))
    assert got[None]["predicted"] == 1 and got[2001]["predicted"] == 0 and 0 <= got[2000]["score"] <= 1
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {x["doc_id"] for x in kept.collect()} == {i for i, x in got.items() if not x["predicted"]}
    assert toxicity.scores(docs.limit(0), labels.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t {i}</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li><a href="/a">A{i}</a></ul></nav>
<div class="cookie-notice">We use cookies</div><{main}><h1>Title {i}</h1><p>First   {i} &amp; more<br>of it<p>Second <b>bold {i}<script>var x="</p>";</script></b> end
<div class="ad">buy {i}</div><p class="share-note">Read on elsewhere</p></{main}><aside>side {i}</aside><form><p>mail</p></form><div id="comments"><p>reader {i}</p></div><footer>&copy; {i}</footer></body></html>"""


@pytest.mark.parametrize("main", ["article", "div"])
def test_wrapper(spark, main):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i=i, main=main)) for i in range(6)]
    pages = spark.createDataFrame([*rows, (90, "http://h.example/x", None), (91, None, ""), (None, "bad url", "<p>alone</p>")], "page_id long, url string, html string")
    got = {x["page_id"]: x for x in wrapper.main_texts(pages).collect()}
    for i in range(6):
        assert got[i]["text"] == f"Title {i}\n\nFirst {i} & more of it\n\nSecond bold {i} end"
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert (got[90]["text"], got[91]["text"], got[None]["text"]) == ("", "", "alone")
    assert wrapper.main_texts(pages.limit(0)).count() == 0


def texts_of(spark, htmls, host="h.example"):
    pages = spark.createDataFrame([(i, f"http://{host}/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    return [x["text"] for x in wrapper.main_texts(pages).orderBy("page_id").collect()]


@pytest.mark.parametrize("titles", ["Same", "Title {i}"])
@pytest.mark.parametrize("page", ["<article>{}</article>", "<main>{}</main>", '<div class="c">{}</div>'])
def test_wrapper_of_reposted_articles(spark, page, titles):
    """Most pages of a host carry one article, under menus and adverts of their own: none loses a paragraph."""
    body = lambda i: (titles.format(i=i), "One story.", "Its end.") if i < 7 else (f"Other {i}", f"Another story {i}.", f"Ends {i}.")
    htmls = [f"<body><nav>menu {i}</nav><div class='ad'>buy {i}</div>" + page.format("<h1>{}</h1><p>{}</p><p>{}</p>".format(*body(i))) + "<div class='x'>About this site</div></body>" for i in range(10)]
    assert texts_of(spark, htmls) == ["\n\n".join(body(i)) for i in range(10)]


ROOTS = [
    "<article><header><h1>T{i}</h1></header><div class='entry-content'><p>{long}</p></div></article>",
    "<article><h1>T{i}</h1><p class='lead'>Lead {i}</p><div class='body'><p>{long}</p></div><p class='end'>End {i}</p></article>",
    "<main><div><h1>T{i}</h1><div class='body'><p>{long}</p></div></div></main>",
    "<div class='post'><h1>T{i}</h1><div class='body'><p>{long}</p></div></div>",
    "<div class='post'>By {i}<div class='body'><p>{long}</p></div></div>",
    "<div class='wrap'><h1>T{i}</h1><article><p>{long}</p></article></div>",
]


@pytest.mark.parametrize("page", ROOTS)
def test_wrapper_with_a_body_beside_the_title(spark, page):
    long = lambda i: f"word{i} " * 200 + "end"
    htmls = [f"<body><nav>menu {i}</nav>" + page.format(i=i, long=long(i)) + "<div class='x'>About this site</div></body>" for i in range(5)]
    for i, text in enumerate(texts_of(spark, htmls)):
        assert text == "\n\n".join(x for x in (f"T{i}" * ("<h1>" in page), f"By {i}" * ("By" in page), f"Lead {i}" * ("Lead" in page), long(i), f"End {i}" * ("End" in page)) if x)


def test_wrapper_of_extra_blocks(spark):
    """A block that the host's reference page lacks is no less part of the text."""
    long = lambda i: f"word{i} " * 200 + "end"
    lead = lambda i: f"<h3 class='late'>Late {i}</h3>" if i > 2 else ""
    htmls = [f"<body><nav>menu {i}</nav><div class='post'>{lead(i)}<div class='body'><p>{long(i)}</p></div></div><div class='x'>About this site</div></body>" for i in range(6)]
    assert texts_of(spark, htmls) == [(f"Late {i}\n\n" if i > 2 else "") + long(i) for i in range(6)]


def test_wrapper_of_very_long_pages(spark):
    """Template behind hundreds of runs is template, in a list of h2 and p as in one of divs in divs."""
    part = lambda i, k: f"<h2>Head {i} {k}</h2><p>text {i} {k}</p>"
    nest = lambda i, k: f"<div><h2>Head {i} {k}</h2><div class='in'><p>text {i} {k}</p></div></div><hr>"
    for piece in (part, nest):
        htmls = [f"<body><div class='c'><h1>T{i}</h1>" + "".join(piece(i, k) for k in range(400 if i % 2 == 0 else 3)) + "<div class='x'>About this site</div></div></body>" for i in range(4)]
        for i, text in enumerate(texts_of(spark, htmls)):
            assert text == "\n\n".join([f"T{i}"] + [x for k in range(400 if i % 2 == 0 else 3) for x in (f"Head {i} {k}", f"text {i} {k}")])


@pytest.mark.parametrize("odd", ["", "plain words", "<p>gone</p>"])
def test_wrapper_with_an_odd_first_page(spark, odd):
    htmls = [odd] + [f"<body><div class='c'><h1>T{i}</h1><p>text {i}</p></div><div class='x'>About this site</div></body>" for i in range(5)]
    assert texts_of(spark, htmls)[1:] == [f"T{i}\n\ntext {i}" for i in range(5)]


def test_roles():
    kept = ['<div class="content no-sidebar">{}</div>', '<div id="page" class="has-comments">{}</div>', '<div class="with-sidebar"><article>{}</article></div>', '<div class="sidebar"><h1>T</h1>{}</div>', '<div class="page social"><div class="widget">{}</div></div>', '<article><section id="related-work">{}</section></article>', '<section id="related-work">{}</section>', '<article><h2 id="share-of-revenue">{}</h2></article>', '<article><h2 id="comments">{}</h2></article>', "<article><p>Let <math><mi>{}</mi></math> be</article>"]
    for html in kept:
        assert "all of it" in " ".join(wrapper.content_of(f"<body>{html.format('all of it')}</body>", None, None)), html
    for name in ("ad", "site-footer", "cookie-notice", "nav_menu", "big comments", "ad-300x250"):
        assert wrapper.content_of(f'<body><article><p>text<div class="{name}">gone</div></article></body>', None, None) == ["text"]
        assert wrapper.content_of(f'<body><p>a text of its own<div class="{name}">gone</div></body>', None, None) == ["a text of its own"]
    assert wrapper.content_of('<body><article>text</article><div class="related"><article>teaser of more</article></div></body>', None, None) == ["text"]
    assert wrapper.content_of('<body><div class="c"><h1>T</h1><p>text</div><div id="comments"><p>many many many readers</div></body>', None, None) == ["T", "text"]
    assert wrapper.content_of('<body><h1>T</h1><div class="social"><p>text</div></body>', None, None) == ["T", "text"]
    assert wrapper.content_of('<body><div class="sidebar"><article>text</article></div><div id="comments"><p>many many readers</div></body>', None, None) == ["text"]


def test_tree_matching():
    a, b = (wrapper.shape(wrapper.tree(h)) for h in ("<div><h1>x</h1><p>1<p>2<ul><li>a</ul></div>", "<div><p>1<ul><li>b<li>c</ul></div>"))
    pairs = {(x.kind, y.kind) for x, y in wrapper.matched(a, b)}
    assert pairs == {("#root", "#root"), ("div.", "div."), ("p.", "p."), ("ul.", "ul."), ("li.", "li.")}
    deep = wrapper.tree("<div>" * 5000 + "text")
    assert wrapper.blocks([deep], set()) == ["text"]
    assert wrapper.shape(deep).size <= wrapper.DEPTH + 1
