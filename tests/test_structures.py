"""Offsets, one-use carries, topic terms and tables written step by step, on odd input."""

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import pages, spatial, topics
from quern.sources import sinks


def test_line_offsets(spark):
    raws = ["a  b\n\n c\td \r\ne\rf", "\n\n x", "one\ntwo\n", "same", "", None, "   ", "é ü\x0bz q", "line  one\nline two", "a\x01b\nc"]
    rows = [(i, r, None, "k") for i, r in enumerate(raws)]
    df = spark.createDataFrame(rows, "id long, raw string, clean string, start string").withColumn("clean", T.clean_text(F.col("raw")))
    df = df.withColumn("clean", F.when(F.col("id") == 3, "other text").when(F.col("id") == 2, F.lit(None)).when(F.col("id") == 7, "é ü z q").otherwise(F.col("clean")))
    cleans = {r["id"]: r["clean"] or "" for r in df.collect()}
    got = defaultdict(list)
    for r in pages.line_offsets(df, ["id"], "raw", "clean").orderBy("id", "line_no").collect():
        got[r["id"]].append((r["start"], r["end"], r["aligned"]))
    for i, raw in enumerate(raws):
        lines = [re.sub(r"[ \t\n ]+", " ", re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", x)).strip(" ") for x in (raw or "").splitlines()]
        want, parts, pos = [], [], 0
        for line in lines:
            pos += bool(line and parts)
            want.append((pos, pos + len(line)))
            parts += [line] if line else []
            pos += len(line)
        fits = " ".join(parts) == cleans[i] != ""
        assert got[i] == [(*w, True) if fits else (0, len(cleans[i]), False) for w in want], (i, raw)
        if fits:
            assert [cleans[i][a:b] for a, b, _ in got[i]] == lines
    assert got[0][0][2] and got[7][0][2] and not got[3][0][2] and not got[2][0][2]


def test_line_offsets_of_many_lines(spark):
    df = spark.range(1).select("id", F.expr("array_join(transform(sequence(1, 100000), i -> concat('line ', i)), '\n')").alias("raw")).withColumn("clean", T.clean_text(F.col("raw")))
    last = pages.line_offsets(df, ["id"], "raw", "clean").agg(F.max("end"), F.count("*"), F.min(F.col("aligned").cast("int")), F.first(F.lit(1))).first()
    assert (last[0], last[1], last[2]) == (len(" ".join(f"line {i}" for i in range(1, 100_001))), 100_000, 1)


def test_carried_once(spark):
    rows = [("a", 1, "lat", 1.0), ("a", 2, "lon", None), ("a", 3, "lon", None), ("a", 4, "lat", 2.0), ("a", 5, "lat", None), ("a", 6, "lon", None), ("a", 7, "both", 3.0), ("a", 8, "lon", None), ("b", 1, "lon", None), ("b", 2, "lat", 4.0), ("b", 3, None, None), ("b", 4, "lon", None), (None, 1, "lat", 5.0), (None, 2, "lon", None)]
    df = spark.createDataFrame(rows, "k string, n int, kind string, v double")
    got = spatial.carried_once(df, ["k"], "n", "kind IN ('lat', 'both')", "v", "kind IN ('lon', 'both')", "used").where("used IS NOT NULL").collect()
    assert sorted((r["k"] or "", r["n"], r["used"]) for r in got) == [("", 2, 5.0), ("a", 2, 1.0), ("a", 7, 3.0), ("b", 4, 4.0)]


def test_topic_terms(spark):
    rows = [(1, "Roads and bridges. Roads were built; the roads-and 12 x", "a", 1), (2, "bridges Bridges", "a", 1), (3, None, "a", 1), (4, "", "b", 1), (5, "dams weirs dams", None, 1), (6, "Über-dam dams", "c", 1), (7, "the and", "d", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, topic string, term int")
    for vocabulary in (8000, 3):
        got = {r["topic"]: (r["size"], r["label"], r["terms"]) for r in topics.topic_terms(df, "topic", vocabulary=vocabulary, most=4).collect()}
        found = {}
        for doc, text, topic, _ in rows:
            w = [x for x in re.findall(r"[^\W]+(?:-[^\W]+)*|-+", (text or "").lower()) if re.fullmatch("[a-z][a-z0-9-]{2,}", x) and x not in topics.STOP]
            found[doc] = (topic, Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]))
        total = sum((c for _, c in found.values()), Counter())
        kept = sorted(total, key=lambda t: (-total[t], t))[:vocabulary]
        df_ = {t: sum(t in c for _, c in found.values()) for t in kept}
        mean = defaultdict(Counter)
        sizes = Counter(t for t, _ in found.values())
        for topic, c in found.values():
            w = {t: c[t] * (math.log((1 + len(rows)) / (1 + df_[t])) + 1) for t in kept if c[t]}
            for t, x in w.items():
                mean[topic][t] += x / math.sqrt(sum(y * y for y in w.values())) / sizes[topic]
        for topic, size in sizes.items():
            best = sorted(mean[topic], key=lambda t: (-round(mean[topic][t], 9), t))[:4]
            assert got[topic] == (size, " / ".join(best[:3]) or f"Topic {topic}", ", ".join(best)), (topic, vocabulary)
    assert topics.topic_terms(df.where("false"), "topic").collect() == []


LINES = "doc string, n int, kind string, override_kind string"


def rows_of(spark, path):
    return sorted(((r["doc"] or "~", r["n"], r["kind"], r["override_kind"]) for r in spark.read.parquet(path).collect()), key=str)


def test_rewritten(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    write = lambda rows, parts=4: sinks.rewritten(spark.createDataFrame(rows, LINES), path, "doc", ["doc", "n"], ("override_kind",), parts)
    write([("a", 1, "x", None), ("a", 2, "x", "mine"), ("b", 1, "x", None), (None, 1, "x", "null's"), ("c", 1, "x", None)])
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("part-*") if p.suffix == ".parquet"}
    write([("a", 2, "y", None), ("a", 3, "y", None), (None, 1, "y", None)])
    want = [("a", 2, "y", "mine"), ("a", 3, "y", None), ("b", 1, "x", None), ("c", 1, "x", None), ("~", 1, "y", "null's")]
    assert rows_of(spark, path) == sorted(want, key=str)
    write([("a", 2, "y", None), ("a", 3, "y", None), (None, 1, "y", None)])
    assert rows_of(spark, path) == sorted(want, key=str)
    assert {p for p in before if p.exists()}  # folders of other documents are as they were
    sinks.rewritten(spark.createDataFrame([("d", 1, "z")], "doc string, n int, kind string"), path, "doc", ["doc", "n"], ("override_kind",), 4)
    assert ("d", 1, "z", None) in rows_of(spark, path)


def test_processed(spark, tmp_path):
    path, ledger = f"file://{tmp_path}/t", f"file://{tmp_path}/ledger"
    docs = lambda rows: spark.createDataFrame(rows, "doc string, text string")
    derive = lambda d: d.select("doc", F.posexplode(F.split("text", " ")).alias("n", "kind"), F.lit(None).cast("string").alias("override_kind"))
    run = lambda rows, make=derive: sinks.processed(docs(rows), path, ledger, "doc", ["text"], make, ["doc", "n"], ("override_kind",), 4)
    first = [("a", "x y"), ("b", "z"), (None, "q")]
    assert run(first) == 3 and run(first) == 0
    assert run([("a", "x y"), ("b", "z w"), (None, "q")]) == 1
    want = sorted([("a", 0, "x", None), ("a", 1, "y", None), ("b", 0, "z", None), ("b", 1, "w", None), ("~", 0, "q", None)], key=str)
    assert rows_of(spark, path) == want
    # killed after the table was written and before the ledger was: the next run writes the same again
    changed = docs([("c", "r")])
    sinks.rewritten(derive(changed), path, "doc", ["doc", "n"], ("override_kind",), 4)
    assert run([("c", "r")]) == 1 and rows_of(spark, path) == sorted([*want, ("c", 0, "r", None)], key=str)


def test_processed_by_batch(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x y"), ("b", "z")], "doc string, text string")
    docs.write.parquet(f"file://{tmp_path}/in/1")
    derive = lambda d: d.select("doc", F.posexplode(F.split("text", " ")).alias("n", "kind"), F.lit(None).cast("string").alias("override_kind"))
    each = lambda b, _: sinks.processed(b, f"file://{tmp_path}/t", f"file://{tmp_path}/ledger", "doc", ["text"], derive, ["doc", "n"], ("override_kind",), 4)
    for checkpoint in ("c1", "c2"):  # the second query meets the same rows again
        stream = spark.readStream.schema("doc string, text string").parquet(f"file://{tmp_path}/in/*")
        stream.writeStream.foreachBatch(each).option("checkpointLocation", f"file://{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()
    assert rows_of(spark, f"file://{tmp_path}/t") == [("a", 0, "x", None), ("a", 1, "y", None), ("b", 0, "z", None)]
    assert spark.read.parquet(f"file://{tmp_path}/ledger").count() == 2


def test_cells_by_level(spark):
    from quern.operators import spatial as S

    rows = [(90.0, -180.0, 1), (-90.0, 180.0, 2), (29.76, -95.37, 3), (29.76, -95.36, None), (None, 1.0, 5), (91.0, 0.0, 6), (0.0, 200.0, 7), (float("nan"), 0.0, 8)]
    df = spark.createDataFrame(rows, "lat double, lon double, v long")
    got = {(r["level"], r["cell"]): (r["parent"], r["n"], r["total"]) for r in S.cells_by_level(df, "lat", "lon", [1, 2, 3, 12], "v").collect()}
    assert got[1, "0"][1:] == (3, 4) and got[1, "3"][1:] == (1, 2) and got[12, "0" * 12][1] == 1 and got[12, "3" * 12][1] == 1
    for level in (1, 2):
        for cell in {c for at, c in got if at == level}:
            below = [v for (at, _), v in got.items() if at == level + 1 and v[0] == cell]
            assert got[level, cell][1:] == (sum(v[1] for v in below), sum(v[2] or 0 for v in below))


def test_nested(spark):
    import json

    from quern.operators import finance

    rows = [("p", "x", "i", 5), ("p", "x", "j", None), ("p", None, "i", 2), ("q", "x", "i", 1), ("p", "x", "i", 4), (None, "x", None, 3)]
    got = {r["name"]: (r["value"], json.loads(r["json"])) for r in finance.nested(spark.createDataFrame(rows, "a string, b string, c string, v long"), ["a", "b", "c"], "v").collect()}
    leaf = lambda n, v: {"name": n, "value": v}
    assert got["p"] == (11, {"name": "p", "value": 11, "children": [{"name": "Unknown", "value": 2, "children": [leaf("i", 2)]}, {"name": "x", "value": 9, "children": [leaf("i", 9), leaf("j", 0)]}]})
    assert got["Unknown"][1]["children"] == [{"name": "x", "value": 3, "children": [leaf("Unknown", 3)]}] and got["q"][0] == 1
    assert finance.nested(spark.createDataFrame([], "a string, b string, c string, v long"), ["a", "b", "c"], "v").collect() == []


def test_paragraphs_of_many_lines(spark):
    df = spark.range(1).select(F.lit(1).alias("doc_id"), F.explode(F.expr("sequence(0, 199999)")).alias("line_no")).withColumn("line", F.when(F.col("line_no") % 2 == 0, "a line. ").otherwise(""))
    got = pages.paragraphs(df)
    assert got.count() == 100_000 and got.where("text <> 'a line.' OR start_line <> end_line OR start_line <> 2 * paragraph").count() == 0


def test_lookups(spark, tmp_path):
    from quern.sources import lookups

    cache = f"file://{tmp_path}/cache"
    frame = lambda rows: spark.createDataFrame(rows, "k string, city string, lat double")
    providers = [("a", lambda k: frame([("x", "X", 1.0), ("x", "W", 2.0), ("y", None, None), ("other", "O", 0.0)])), ("b", lambda k: frame([("x", "no", 9.0), ("y", None, 3.0)])), ("c", lambda k: frame([]))]
    wanted = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    run = lambda *k: lookups.looked_up(wanted(*k), cache, providers, "k", "city string, lat double")
    got, asked = run("x", "x", None)
    assert asked == {"a": 1, "b": 0, "c": 0} and [tuple(r) for r in got.collect()] == [("x", "W", 2.0, "a")]
    got, asked = run("x", "y", "z")
    assert asked == {"a": 2, "b": 2, "c": 1} and sorted(map(tuple, got.collect())) == [("x", "W", 2.0, "a"), ("y", None, 3.0, "b"), ("z", None, None, None)]
    assert run("x", "y", "z")[1] == {"a": 0, "b": 0, "c": 0}  # nothing is asked again, not what nobody knew either
    spark.createDataFrame([("x", "no json", 9), ("y", '{"city": "by hand"}', 9)], "k string, response string, run int").write.mode("append").parquet(cache)
    got, asked = run("x", "y")
    assert asked == {"a": 1, "b": 0, "c": 0} and sorted(map(tuple, got.collect())) == [("x", "W", 2.0, "a"), ("y", "by hand", None, None)]


def test_split_evenly(spark):
    from quern.operators import changes

    rows = [("a", "q", "1", 10.0), ("a", "q", "2", 10.0), (None, "q", "1", 4.0), ("b", None, "1", 6.0), ("b", None, "1", 6.0), ("c", "q", None, 5.0), ("d", "q", "2", None)]
    got = changes.split_evenly(spark.createDataFrame(rows, "activity_code string, quarter string, zip string, total double"), ["activity_code", "quarter"], "zip", "total").collect()
    assert {(r["zip"], r["quarter"]): (r["total"], r["activities"]) for r in got} == {("1", "q"): (9.0, 1), ("2", "q"): (5.0, 2), ("1", None): (6.0, 1), (None, "q"): (None, 1)}
