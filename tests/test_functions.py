"""Scalar functions and operators on literal cases."""

import re

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import changes, documents, resolve, spatial, vectors
from quern.sources import files, sinks


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("$1,234.56", 1234.56), ("57.8M", 57.8e6), ("$5.2 billion", 5.2e9), ("$100k", 1e5), ("1234", 1234.0), ("", None), ("not a number", None), ("$1,234.", 1234.0), (None, None)],
)
def test_parse_usd(spark, text, want):
    got = one(spark, text, T.parse_usd)
    assert got == want if want is None else got == pytest.approx(want)


@pytest.mark.parametrize(
    ("name", "want"),
    [("drgr-2019-disasters-2025-q4.pdf", ("2019-disasters", 2025, 4)), ("h5b-2024-q3.pdf", ("h5b", 2024, 3)), ("mit-2025-q1.pdf", ("mit", 2025, 1)), ("notes.pdf", ("notes", None, None)), ("q2-2021.pdf", ("unknown", 2021, 2))],
)
def test_file_facts(spark, name, want):
    assert tuple(one(spark, name, T.file_facts)) == want


def test_clean_text(spark):
    assert one(spark, "a\r\n b \x00 c \n", T.clean_text) == "a b c"
    assert one(spark, " a  b \n\n\n\n c\t", lambda c: T.clean_text(c, True)) == "a b\n\n c".strip()


@pytest.mark.parametrize("text", ["", "no number", "1 and 22, é 333 4", "7", "ß7ß8ß"])
def test_spans(spark, text):
    got = [tuple(s) for s in one(spark, text, lambda c: T.spans(c, "[0-9]+"))]
    assert got == [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", text)]


def test_overlaps(spark):
    df = spark.sql("SELECT array(named_struct('p', 0, 'start', 0, 'end', 16), named_struct('p', 1, 'start', 10, 'end', 20), named_struct('p', 2, 'start', 30, 'end', 35)) AS s")
    assert [x["start"] for x in df.select(T.without_overlaps(F.col("s")).alias("k")).first()["k"]] == [0, 30]


def test_chunks(spark):
    for n in range(1, 30):
        words = [f"w{i}" for i in range(n)]
        want, k = [], 0
        while True:
            want.append(" ".join(words[k : k + 4]))
            if k + 4 >= n:
                break
            k += 3
        assert one(spark, " ".join(words), lambda c: T.chunk_words(c, 4, 1)) == want
    assert one(spark, "", lambda c: T.chunk_words(c, 4, 1)) == []


def test_sentences(spark):
    got = [tuple(s) for s in one(spark, "One two. Three?  Four", T.sentences)]
    assert got == [(0, 8, "One two."), (9, 15, "Three?"), (17, 21, "Four")]


@pytest.mark.parametrize(
    ("text", "want"),
    [("The drawdown of $5", ("drawdown", 0.9)), ("We draw down of $5", ("drawdown", 0.75)), ("The budget of $5", ("budget", 0.75)), ("total budget: $5", ("budget", 0.9)), ("Here is $5", ("unknown", 0.1))],
)
def test_money_context(spark, text, want):
    at = text.index("$")
    assert tuple(one(spark, text, lambda c: T.money_context(c, F.lit(at), F.lit(at + 2)))) == want


def test_places(spark):
    assert one(spark, "Zip Codes 77001 - 77003, 77011", T.zip_codes) == ["77001", "77002", "77003", "77011"]
    assert [one(spark, x, T.tract_code) for x in ("12.3", "312", "1234567")] == ["001230", "000312", "1234567"]
    assert one(spark, "The A & B, Inc.", T.normalize_key) == "a and b inc"
    rows = spark.createDataFrame([(1, '[["Address","City",null],["1 Main St","Houston","x"]]'), (2, "junk"), (3, None)], "id long, table_data string")
    (r,) = spatial.table_rows(rows, keep=("id",)).collect()
    assert (r["id"], r["row_index"], r["address"], r["city"], r["zip"]) == (1, 1, "1 Main St", "Houston", None)


def test_entities(spark):
    found = one(spark, "DR-4332: $5 million, 12 homes, Q3 2020", T.entities)
    assert {(s["type"], s["text"]) for s in found} >= {("FEMA_DECLARATION", "DR-4332"), ("MONEY", "$5 million"), ("DAMAGE_METRIC", "12 homes"), ("QUARTER", "Q3 2020")}


def test_changes(spark):
    rows = [(1, "A", "Q1 2020", 2020, 1, 10.0, "x"), (2, "B", "Q1 2020", 2020, 1, 5.0, "x"), (3, "C", "Q1 2020", 2020, 1, 7.0, "x"), (4, "A", "Q2 2020", 2020, 2, 12.0, "x"), (5, "C", "Q2 2020", 2020, 2, 9.0, "x"), (6, "C", "Q2 2020", 2020, 2, 7.0, "x"), (7, "D", "Q2 2020", 2020, 2, 1.0, "x")]
    df = spark.createDataFrame(rows, "id long, activity_code string, quarter string, year int, quarter_num int, total_budget double, status string")
    got = {r["activity_code"]: (r["budget_change"], r["status_change"]) for r in changes.period_changes(df).collect()}
    assert got == {"A": (2.0, None), "B": (-5.0, "Removed"), "D": (1.0, "New")}


def test_sections(spark):
    df = spark.createDataFrame([(1, "intro\n\nFUNDING PLAN\ntext\n\nmore text here.\nStatus:\nok")], "doc_id long, text string")
    got = [(r["heading"], r["start_line"], r["end_line"]) for r in documents.sections(df).orderBy("section_index").collect()]
    assert got == [("Document", 0, 1), ("FUNDING PLAN", 2, 5), ("Status:", 6, 7)]


def test_scores_and_groups(spark):
    gold, found = (spark.createDataFrame([(x,) for x in v], "k string") for v in ("abc", "bcde"))
    assert tuple(resolve.scores(gold, found, ["k"]).first()) == (2, 2, 1, 0.5, 0.666667, 0.571429)
    v = [(0, [1.0, 0.0], 9.0), (1, [0.99, 0.05], 8.0), (2, [0.0, 1.0], 7.0), (3, [0.02, 1.0], 6.0)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>, score double")
    assert sorted((r["vec_id"], r["grp"]) for r in vectors.greedy_groups(df.withColumn("label", F.lit(1)), 0.9).collect()) == [(0, 0), (1, 0), (2, 1), (3, 1)]


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "mit").mkdir()
    (tmp_path / "mit" / "mit-2025-q1.txt").write_text("hello")
    (tmp_path / "mit" / "mit-ap-2025-q1.txt").write_text("no")
    (r,) = files.report_files(spark, str(tmp_path), without="-ap-").collect()
    assert (r["category"], r["disaster_code"], r["year"], r["text"]) == ("mit", "mit", 2025, "hello")
    (tmp_path / "f.json").write_text('{"features": [{"properties": {"NAME": "a", "x": 1}, "geometry": {"type": "Point"}}, {"properties": {"x": 2}, "geometry": null}]}')
    assert files.property_key(files.features(spark, str(tmp_path / "f.json")), ["NAME", "x"]).first()["key"] == "x"
    old = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    new = spark.createDataFrame([(2, "b", 1), (2, "c", 2), (3, "d", 1)], "k long, v string, o long")
    assert sorted(map(tuple, sinks.upserted(old, new, ["k"], "o").select("k", "v").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(r["k"] for r in sinks.inserted(old, new, ["k"]).collect()) == [1, 2, 3]
    assert dict(map(tuple, sinks.filled(old, new.where("o = 1"), ["k"], ["v"]).collect())) == {1: "a", 2: "b"}
    sinks.sidecars(spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "doc string, page int"), str(tmp_path / "side"), "doc")
    assert sorted(r["page"] for r in spark.read.json(str(tmp_path / "side" / "doc=a")).collect()) == [1, 2]
    assert sorted((r["doc"] or "", r["page"]) for r in spark.read.json(str(tmp_path / "side")).collect()) == [("", 3), ("a", 1), ("a", 2)]
    sinks.to_csv(old, str(tmp_path / "out"), ["k"])
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2


def test_stream_equals_table(spark, tmp_path):
    from quern.streaming.rollups import event_stream, tumbling

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = tumbling(event_stream(spark, str(tmp_path / "in"), "event_id long, ts timestamp, user_id long, event_type string, value double, props string"), "1 day", "30 days")
    query = stream.writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got, want = (sorted((str(r["starts"]), r["event_type"], r["events"]) for r in df.collect()) for df in (spark.table("daily"), tumbling(events, "1 day")))
    assert got == want


def test_edges_by_sentence(spark):
    """Names behind the first five of a document are paired too, and only within their sentence."""
    first = "Albany Boston Carson Dallas Easton Fresno meet."
    docs = spark.createDataFrame([(i, f"{first} Then Gardena and Houston.\nIrvine saw Jackson!") for i in range(3)] + [(9, None), (10, "")], "doc_id long, text string")
    got = {(r["subject"], r["object"]): r["weight"] for r in resolve.edges(documents.in_sentences(docs), ["doc_id", "sentence"], "entity_text").collect()}
    names = first.split()[:5]
    assert got == {(a, b): 3 for a in names for b in names if a < b} | {("Gardena", "Houston"): 3, ("Irvine", "Jackson"): 3}


def test_spans_of_very_long_texts(spark):
    """Ten thousand matches in one text: offsets are right, and take time in proportion."""
    import re
    import time

    text = "".join(f"é{'x' * (i % 7)} Name{'abc'[i % 3] * (i % 5)}! " for i in range(10_000))
    df = spark.createDataFrame([(text,), ("",), ("none",), (None,)], "t string")
    began = time.time()
    got = df.select(T.spans(F.col("t"), "Name[a-c]*").alias("s"), T.sentences(F.col("t")).alias("u")).collect()
    assert time.time() - began < 30
    assert [(x["start"], x["end"], x["text"]) for x in got[0]["s"]] == [(m.start(), m.end(), m.group()) for m in re.finditer("Name[a-c]*", text)]
    assert len(got[0]["u"]) == 10_000 and all(text[x["start"] : x["end"]] == x["text"] for x in got[0]["u"])
    assert got[1]["s"] == got[2]["s"] == [] and got[3]["s"] is None


def test_vector_groups_and_clusters(spark):
    """Against a plain loop over all rows of each topic; a row's score follows from its cluster's centre."""
    import numpy as np

    from quern import registry

    sf = "/root/testdata/sf0.001"
    rows = sorted(map(tuple, spark.read.parquet(f"{sf}/embeddings.parquet").select("label", "vec_id", "embedding").collect()))
    sums, want = {}, {}
    for label, i, v in rows:
        x = np.array(v, float) / np.linalg.norm(np.array(v, float))
        own = sums.setdefault(label, [])
        near = [x @ s / np.linalg.norm(s) for s in own]
        best = int(np.argmax(near)) if near else -1
        if best >= 0 and near[best] >= 0.3:
            own[best] = own[best] + x
        else:
            best = len(own)
            own.append(x)
        want[i] = (label, best)
    assert {r["vec_id"]: (r["label"], r["grp"]) for r in registry.queries()["vector_groups"](spark, sf).collect()} == want
    got = registry.queries()["vector_clusters"](spark, sf).collect()
    by_id, members = {i: np.array(v, float) for _, i, v in rows}, {}
    for r in got:
        members.setdefault(r["cluster"], []).append(r["vec_id"])
    assert sorted(r["vec_id"] for r in got) == sorted(by_id) and len(members) == 8
    centre = {c: np.mean([by_id[i] for i in ids], axis=0) for c, ids in members.items()}
    assert max(abs(r["score"] - 1 / (1 + np.linalg.norm(by_id[r["vec_id"]] - centre[r["cluster"]]))) for r in got) < 0.02


def test_range_joins_and_paragraphs(spark):
    """Literal cases: a group ends at the next header, ties of ranges, bullets, long paragraphs."""
    from quern.operators import pages as P

    pages = spark.createDataFrame([(1, 1, "x"), (1, 2, "H"), (1, 3, "x"), (1, 4, "H"), (2, 1, "x")], "document_id int, page_number int, text string")
    assert sorted((r["document_id"], r["page_number"], r["header_page"]) for r in P.page_groups(pages, F.col("text") == "H").collect()) == [(1, 2, 2), (1, 3, 2), (1, 4, 4)]
    lines = ["a", "b", "", "- one", "two", "* three", "", "y" * 900 + ".", "z", ""]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, ""), (3, None)], "doc_id int, text string")
    got = [(r["doc_id"], r["start_line"], r["end_line"], r["text"][:7]) for r in P.paragraphs(documents.lines(df)).orderBy("doc_id", "paragraph").collect()]
    assert got == [(1, 0, 1, "a b"), (1, 3, 4, "- one t"), (1, 5, 5, "* three"), (1, 7, 7, "yyyyyyy"), (1, 8, 8, "z")]
    points = spark.createDataFrame([("k", 1, 5), ("k", 2, 50)], "k string, line int, at int")
    spans = spark.createDataFrame([("k", 0, 10, None), ("k", 3, 9, 7), ("k", 4, 9, 6)], "k string, s_start int, s_end int, section_id int")
    assert sorted((r["line"], r["section_id"]) for r in P.covering(points, spans, "k", ["k", "line"], "at").collect()) == [(1, 7), (2, None)]
