"""Joins of ranges against plain loops: bins, borders, empty and null ranges, very many spans in one text."""

import random

from pyspark.sql import functions as F

from quern.operators import pages, resolve


def ranges(seed, n, wide):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a = r.choice([r.randrange(6000), 1024 * r.randrange(6)])
        out.append((r.choice(["a", "b", None]), a, a + r.choice([0, 1, 3, r.randrange(wide), 1024]), i))
    return [*out, ("a", None, 5, n), ("a", 5, None, n + 1)]


def test_inside(spark):
    spans, windows = ranges(1, 200, 300), ranges(2, 60, 4000)
    got = resolve.inside(spark.createDataFrame(spans, "k string, start int, end int, i int"), spark.createDataFrame(windows, "k string, w_start int, w_end int, w int"), "k").collect()
    want = {(i, w) for k, a, b, i in spans for kk, c, d, w in windows if k is not None and k == kk and None not in (a, b, c, d) and a >= c and b <= d}
    assert {(r["i"], r["w"]) for r in got} == want and len(got) == len(want) > 50


def test_overlapping(spark):
    rows, spans = [*ranges(3, 80, 3000), ("a", 10, 2000, 7), ("a", 10, 2000, 7)], ranges(4, 30, 900)
    got = pages.overlapping(spark.createDataFrame(rows, "k string, start int, end int, i int"), spark.createDataFrame(spans, "k string, s_start int, s_end int, i int"), "k").collect()
    want = [x for x in rows if any(k is not None and k == x[0] and None not in (*x, a, b) and a < x[2] and b > x[1] for k, a, b, _ in spans)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and 2 < len(want) < len(rows)


def test_covering(spark):
    points = [(k, i, a) for k, a, _, i in ranges(5, 120, 10)]
    spans = [(k, a, b, i if i % 3 else None) for k, a, b, i in ranges(6, 60, 2500)]
    got = pages.covering(spark.createDataFrame(points, "k string, line int, at int"), spark.createDataFrame(spans, "k string, s_start int, s_end int, section_id int"), "k", ["k", "line"], "at").collect()
    first = lambda k, at: min((x[3] is None, x[1], x[2], x[3] or 0, x) for x in [*spans, (k, 10**9, 10**9, None)] if x[0] == k and (x[1] == 10**9 or (None not in (at, x[1], x[2]) and x[1] <= at < x[2])))[4]
    want = {(k, i): None if k is None else first(k, at)[3] for k, i, at in points}
    assert {(r["k"], r["line"]): r["section_id"] for r in got} == want and len(got) == len(points)


def test_many_spans_in_one_text(spark):
    spans = spark.range(100_000).select(F.lit(1).alias("k"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 7).alias("end"))
    windows = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") * 50).alias("w_start"), (F.col("id") * 50 + 50).alias("w_end"))
    assert resolve.inside(spans, windows, "k").count() == 100_000
    rows = windows.select("k", F.col("w_start").alias("start"), F.col("w_end").alias("end"))
    assert pages.overlapping(rows, spans.select("k", F.col("start").alias("s_start"), F.col("end").alias("s_end")), "k").count() == 20_000
    lines = spans.select(F.lit(1).alias("doc_id"), (F.col("start") / 10).cast("int").alias("line_no"), F.lit("x").alias("line"))
    parts = windows.select(F.lit(1).alias("doc_id"), (F.col("w_start") / 50).cast("int").alias("section_index"), (F.col("w_start") / 10).cast("int").alias("start_line"), (F.col("w_start") / 10 + 4).cast("int").alias("end_line"), F.lit("h").alias("heading"))
    assert pages.section_text(lines, parts).where("text = 'x\nx\nx\nx\nx'").count() == 20_000
