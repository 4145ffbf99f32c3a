"""Which lines are read again for a comparison."""

from quern.llm import line_dedup


def test_sizes_that_cannot_match_are_not_read_again(spark):
    shared = " ".join(f"s{k}" for k in range(12))
    long = lambda name, n: shared + " " + " ".join(f"{name}{k}" for k in range(n))
    near = [" ".join(f"n{k}" for k in range(60)), " ".join(f"n{k}" for k in range(60)) + " z"]
    rows = [(1, shared), (2, long("a", 40)), (3, long("b", 100)), (4, near[0]), (5, near[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = line_dedup._prefixes(line_dedup._hashed(line_dedup.lines_of(docs)), [0] * line_dedup.SLOTS)
    whole = line_dedup._classes(lines).selectExpr("h", "first.doc_id AS doc_id", "explode(prefix) AS t")
    several = whole.groupBy("t").count().where("count > 1").join(whole, "t")
    assert {r["doc_id"] for r in several.collect()} > {4, 5}  # the three share tokens, but no two of a like size
    met = line_dedup._met(lines).join(whole.select("h", "doc_id").distinct(), "h")
    assert {r["doc_id"] for r in met.collect()} == {4, 5}
    gone = line_dedup.repeated_lines(docs).collect()
    assert [(r["doc_id"], r["line_no"]) for r in gone] == [(5, 0)]
