"""Registered queries over report pages: joins by range, page groups, activity panels, paragraphs, links, edges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import rules as R
from quern.operators import documents as docs_
from quern.operators import pages as P
from quern.operators import resolve
from quern.plans.texts import LINES, SPANS, documents
from quern.registry import register
from quern.sources.tables import VIEWS, activities, allocations, table


def n():
    return F.count(F.lit(1)).cast("bigint")


def money(c):
    return F.round(F.sum(c), 2)


# --- report pages: one document a customer, one page an order; every third page begins an activity --------------

PAGES = """p AS (SELECT o_custkey AS document_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS page_number, o_orderkey, o_orderkey % 3 = 0 AS is_header,
  CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Under Way' ELSE 'Cancelled' END AS status, o_totalprice AS amount, o_orderpriority AS county, o_orderkey % 10 AS score FROM orders),
g AS (SELECT * FROM (SELECT *, max(CASE WHEN is_header THEN page_number END) OVER (PARTITION BY document_id ORDER BY page_number) AS header_page FROM p) WHERE header_page IS NOT NULL)"""


def report_pages(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", "Under Way").otherwise("Cancelled")
    head = F.concat(F.lit("Activity Status:\nHousing repair\n$ 5.00\n"), status, F.lit("\nProject Number: "), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit("\nLow/Mod 1 1/2 1/2 "), F.col("o_orderkey") % 50, F.lit("/99 # of Households 0 0 1"))
    more = F.concat(F.lit("continued\nLow/Mod 2 1/2 1/2 "), F.col("o_orderkey") % 50, F.lit("/99 # of Households 0 0 1"))
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("bigint")
    return o.select(
        F.col("o_custkey").alias("document_id"), number.alias("page_number"), F.when(F.col("o_orderkey") % 3 == 0, head).otherwise(more).alias("text"), F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("county"),
        (F.col("o_orderkey") % 10).alias("score"),
    )


def grouped(spark, d):
    return P.page_groups(report_pages(spark, d), F.contains("text", F.lit("Activity Status:")))


ACTIVITY_GROUPS = f"""WITH {PAGES}, s AS (SELECT document_id, header_page, county, sum(score) AS s, min(page_number) AS f FROM g GROUP BY 1, 2, 3)
SELECT document_id || ':' || header_page AS activity_id, document_id, header_page, max(page_number) AS end_page, count(*) AS n_pages, lpad(CAST(arg_min(o_orderkey, page_number) AS VARCHAR), 9, '0') AS project_number,
  arg_min(status, page_number) AS status, 'Housing repair' AS type, round(sum(amount), 2) AS amount, round(max(amount), 2) AS largest, max(o_orderkey % 50) AS households, any_value(b.county) AS county
FROM g JOIN (SELECT document_id, header_page, county FROM s QUALIFY row_number() OVER (PARTITION BY document_id, header_page ORDER BY s DESC, f, county) = 1) b USING (document_id, header_page) GROUP BY document_id, header_page"""


@register("activity_groups", ACTIVITY_GROUPS)
def activity_groups(spark, d):
    """A row an activity: fields of its header page, money and beneficiaries of all its pages, and the county
    with the highest summed score."""
    pages = grouped(spark, d)
    keys = ["document_id", "header_page"]
    county = P.best(pages.groupBy(*keys, "county").agg(F.sum("score").alias("s"), F.min("page_number").alias("f")), keys, F.desc("s"), "f", "county").select(*keys, "county")
    measured = F.array_max(F.transform(R.beneficiary_rows(F.col("text")), lambda x: F.when(x["canonical_measure"] == "households", x["total_actual"])))
    head = F.min_by("text", "page_number")
    out = pages.groupBy(*keys).agg(F.max("page_number").alias("end_page"), n().alias("n_pages"), head.alias("head"), money("amount").alias("amount"), F.round(F.max("amount"), 2).alias("largest"), F.max(measured).alias("households"))
    fields = out.join(county, keys).select("*", R.status_and_type(F.col("head")).alias("x"))
    return fields.select(F.concat_ws(":", *keys).alias("activity_id"), *keys, "end_page", "n_pages", R.project_number(F.col("head")).alias("project_number"), "x.status", "x.type", "amount", "largest", "households", "county")


@register("beneficiary_measures_by_page", f"WITH {PAGES} SELECT document_id, header_page, page_number, 'households' AS measure, CASE WHEN is_header THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS this_period, o_orderkey % 50 AS total_actual FROM g")
def beneficiary_measures_by_page(spark, d):
    rows = grouped(spark, d).select("document_id", "header_page", "page_number", F.inline(R.beneficiary_rows(F.col("text"))))
    return rows.select("document_id", "header_page", "page_number", "measure", "this_period", "total_actual")


STATUS_RANK = "CASE status WHEN 'Completed' THEN 0 WHEN 'Under Way' THEN 1 WHEN 'Cancelled' THEN 2 ELSE 3 END"


@register(
    "activities_unique",
    VIEWS + f"SELECT activity_code, quarter, arg_min(status, ({STATUS_RANK}, id)) AS status, arg_min(county, ({STATUS_RANK}, id)) FILTER (county IS NOT NULL) AS county, round(max(total_budget), 2) AS total_budget, min(id) AS id, count(*) AS n FROM activities GROUP BY 1, 2",
)
def activities_unique(spark, d):
    """N4, A41, O5, O-DEDUP-1: of rows with one code and quarter the best status, the first county that is known, the largest budget, the smallest id."""
    rank = F.when(F.col("status") == "Completed", 0).when(F.col("status") == "Under Way", 1).when(F.col("status") == "Cancelled", 2).otherwise(3)
    order = F.struct(rank, "id")
    first_known = F.min(F.when(F.col("county").isNotNull(), F.struct(rank.alias("r"), "id", "county")))["county"]
    return activities(spark, d).groupBy("activity_code", "quarter").agg(F.min_by("status", order).alias("status"), first_known.alias("county"), F.round(F.max("total_budget"), 2).alias("total_budget"), F.min("id").alias("id"), n().alias("n"))


# --- joins by range ---------------------------------------------------------------------------------------------


@register("windows_with_spans", f"WITH {SPANS}, w AS (SELECT doc_id, unnest(range(0, length(text) // 50 + 1)) AS w FROM documents) SELECT doc_id, CAST(w AS BIGINT) AS w FROM w WHERE EXISTS (SELECT 1 FROM s WHERE s.doc_id = w.doc_id AND s.start < w.w * 50 + 50 AND s.start + length(entity_text) > w.w * 50)")
def windows_with_spans(spark, d):
    """J13."""
    own = documents(spark, d)
    windows = own.select("doc_id", F.explode(F.sequence(F.lit(0), F.expr("cast(length(text) div 50 as int)"))).alias("w")).select("doc_id", F.col("w").cast("bigint").alias("w"), (F.col("w") * 50).alias("start"), (F.col("w") * 50 + 50).alias("end"))
    spans = docs_.capitalised(own).select("doc_id", F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    return P.overlapping(windows, spans, "doc_id").select("doc_id", "w")


@register(
    "covering_sections",
    """WITH s AS (SELECT l_orderkey AS k, l_linenumber * 10 AS s_start, l_linenumber * 10 + CAST(l_quantity AS INTEGER) AS s_end, CASE WHEN l_partkey % 3 > 0 THEN l_partkey END AS section_id FROM lineitem),
p AS (SELECT l_orderkey AS k, l_linenumber AS line, l_linenumber * 10 + 15 AS at FROM lineitem)
SELECT k, line, section_id FROM (SELECT p.k, p.line, s.section_id, row_number() OVER (PARTITION BY p.k, p.line ORDER BY s.section_id IS NULL, s.s_start NULLS LAST, s.s_end NULLS LAST, s.section_id NULLS LAST) AS r FROM p LEFT JOIN s ON p.k = s.k AND s.s_start <= p.at AND p.at < s.s_end) WHERE r = 1""",
)
def covering_sections(spark, d):
    """J14."""
    items = table(spark, d, "lineitem")
    begin = F.col("l_linenumber") * 10
    spans = items.select(F.col("l_orderkey").alias("k"), begin.alias("s_start"), (begin + F.col("l_quantity").cast("int")).alias("s_end"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_partkey")).alias("section_id"))
    points = items.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), (begin + 15).alias("at"))
    return P.covering(points, spans, "k", ["k", "line"], "at").select("k", "line", "section_id")


@register("page_headings", "SELECT document_id, page, arg_max(heading, (start_page, ord, heading)) AS heading FROM (SELECT l_orderkey AS document_id, unnest(range(l_linenumber, l_linenumber + CAST(l_quantity AS INTEGER) % 4 + 1)) AS page, l_linenumber AS start_page, l_partkey AS ord, l_returnflag || l_partkey AS heading FROM lineitem) GROUP BY 1, 2")
def page_headings(spark, d):
    """J15."""
    start = F.col("l_linenumber").cast("bigint")
    return P.headings_of_pages(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), start.alias("start_page"), (start + F.col("l_quantity").cast("int") % 4).alias("end_page"), F.col("l_partkey").alias("ord"), F.concat("l_returnflag", F.col("l_partkey")).alias("heading")))


# --- lines ------------------------------------------------------------------------------------------------------


@register("line_neighbours", f"WITH {LINES} SELECT doc_id, line_no, lead(line) OVER w AS following, lag(line) OVER w AS before FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)")
def line_neighbours(spark, d):
    """W10, W11."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    return docs_.lines(documents(spark, d)).select("doc_id", "line_no", F.lead("line").over(w).alias("following"), F.lag("line").over(w).alias("before"))


@register(
    "paragraphs",
    r"""WITH RECURSIVE l AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS t FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f\v]+', ' ', 'g'), ' ')) AS p FROM documents WHERE doc_id % 10 < 10)),
r(doc_id, i, g, n) AS (SELECT doc_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM (SELECT DISTINCT doc_id FROM l) UNION ALL
  SELECT l.doc_id, l.i, CASE WHEN t = '' THEN r.g WHEN r.n = 0 OR regexp_matches(t, '^(?:[\x{2022}\-*]|(?:\(?\d+\)?[.)]))\s+') THEN r.g + 1 ELSE r.g END,
  CASE WHEN t = '' THEN 0 ELSE CASE WHEN (CASE WHEN r.n = 0 OR regexp_matches(t, '^(?:[\x{2022}\-*]|(?:\(?\d+\)?[.)]))\s+') THEN length(t) ELSE r.n + 1 + length(t) END) >= 900 AND regexp_matches(t, '[.!?]$') THEN 0
    ELSE (CASE WHEN r.n = 0 OR regexp_matches(t, '^(?:[\x{2022}\-*]|(?:\(?\d+\)?[.)]))\s+') THEN length(t) ELSE r.n + 1 + length(t) END) END END FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1)
SELECT doc_id, CAST(g - 1 AS INTEGER) AS paragraph, CAST(min(i) - 1 AS INTEGER) AS start_line, CAST(max(i) - 1 AS INTEGER) AS end_line, string_agg(t, ' ' ORDER BY i) AS text FROM r JOIN l USING (doc_id, i) WHERE t <> '' GROUP BY doc_id, g""".replace(" WHERE doc_id % 10 < 10", ""),
)
def paragraphs(spark, d):
    """W8."""
    return P.paragraphs(docs_.lines(documents(spark, d)))


@register("section_texts", "SELECT doc_id, CAST(0 AS INTEGER) AS section_index, array_to_string(CASE WHEN trim(p[1], ' ') = 'x' THEN p[2:3] ELSE p[1:3] END, chr(10)) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)")
def section_texts(spark, d):
    """the lines 0 to 2 of each document as one section."""
    own = documents(spark, d)
    spans = own.select("doc_id", F.lit(0).alias("section_index"), F.lit(0).alias("start_line"), F.lit(2).alias("end_line"), F.lit("x").alias("heading"))
    return P.section_text(docs_.lines(own), spans)


@register("distinct_canonical_texts", r"""SELECT t AS canonical, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM (SELECT doc_id, lower(trim(regexp_replace(translate(text, '’‘“”', '''''""'), '[ \t\n\r\f\v\x{00A0}]+', ' ', 'g'), ' ')) AS t FROM documents) GROUP BY 1 HAVING count(*) > 1""")
def distinct_canonical_texts(spark, d):
    """O-DEDUP-6, W17."""
    return documents(spark, d).groupBy(R.canonical_text(F.col("text")).alias("canonical")).agg(n().alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("n > 1")


# --- links, edges and evaluation --------------------------------------------------------------------------------

MENTIONS = "m AS (SELECT l_orderkey AS u, CASE l_linestatus WHEN 'F' THEN 'ORG' ELSE CASE WHEN l_partkey % 2 = 0 THEN 'TX_COUNTY' ELSE 'MONEY' END END AS kind, 'n' || (l_partkey % 20) AS name, l_linenumber AS start FROM lineitem)"


def mentions(spark, d):
    kind = F.when(F.col("l_linestatus") == "F", "ORG").when(F.col("l_partkey") % 2 == 0, "TX_COUNTY").otherwise("MONEY")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("u"), kind.alias("kind"), F.concat(F.lit("n"), F.col("l_partkey") % 20).alias("name"), F.col("l_linenumber").alias("start"))


@register(
    "typed_relation_edges",
    f"""WITH {MENTIONS}, f AS (SELECT u, kind, name, min(start) AS start FROM m GROUP BY 1, 2, 3), c AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY u, kind ORDER BY start, name) <= 2),
k AS (SELECT * FROM c QUALIFY count(*) OVER (PARTITION BY u) BETWEEN 2 AND 4), t AS (SELECT *, list_position(['ORG', 'PROGRAM', 'TX_COUNTY', 'MONEY'], kind) AS r FROM k)
SELECT a.kind AS source_type, a.name AS source, b.kind AS target_type, b.name AS target, count(*) AS weight FROM t a JOIN t b USING (u)
WHERE (a.r < b.r OR a.r = b.r AND a.name < b.name) AND (a.kind, b.kind) IN (('ORG', 'ORG'), ('ORG', 'MONEY'), ('TX_COUNTY', 'MONEY')) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2""",
)
def typed_relation_edges(spark, d):
    """Caps by type and in total, allowed pairs of types, one direction."""
    few = P.capped_by_type(mentions(spark, d), ["u"], "kind", "name", 2, 2, 4)
    return P.typed_edges(few, ["u"], "kind", "name", ["ORG", "PROGRAM", "TX_COUNTY", "MONEY"], [("ORG", "ORG"), ("ORG", "MONEY"), ("TX_COUNTY", "MONEY")], 2)


@register("money_entity_links", f"WITH {MENTIONS} SELECT DISTINCT a.u, a.start AS money, b.kind, b.name FROM m a JOIN m b USING (u) WHERE a.kind = 'MONEY' AND b.kind <> 'MONEY'")
def money_entity_links(spark, d):
    """G9."""
    m = mentions(spark, d)
    money, named = m.where("kind = 'MONEY'").select("u", F.col("start").alias("money")), m.where("kind <> 'MONEY'").select("u", "kind", "name")
    return money.distinct().join(named.distinct(), "u")  # pairs of distinct rows are distinct: they are not held once more


@register("top_entities_by_money", f"WITH {MENTIONS} SELECT b.name, count(DISTINCT (a.u, a.start)) AS amounts FROM m a JOIN m b USING (u) WHERE a.kind = 'MONEY' AND b.kind <> 'MONEY' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2000")
def top_entities_by_money(spark, d):
    """A32."""
    return money_entity_links(spark, d).select("u", "money", "name").distinct().groupBy("name").agg(n().alias("amounts")).orderBy(F.desc("amounts"), "name").limit(2000)


ALIAS = "a AS (SELECT name AS alias, 'n' || (CAST(substr(name, 2) AS INTEGER) // 2) AS canonical FROM (SELECT DISTINCT name FROM m) WHERE CAST(substr(name, 2) AS INTEGER) < 12)"


def aliases(spark, d):
    number = F.substring("alias", 2, 9).cast("int")
    return mentions(spark, d).select(F.col("name").alias("alias")).distinct().where(number < 12).select("alias", F.concat(F.lit("n"), F.expr("cast(substring(alias, 2) as int) div 2")).alias("canonical"))


@register("resolved_mentions", f"WITH {MENTIONS}, {ALIAS} SELECT coalesce(canonical, name) AS canonical, count(*) AS mentions FROM m LEFT JOIN a ON name = alias GROUP BY 1")
def resolved_mentions(spark, d):
    """G3."""
    return resolve.resolved(mentions(spark, d), aliases(spark, d), "name").groupBy("canonical").agg(n().alias("mentions"))


@register("alias_counts", f"WITH {MENTIONS}, {ALIAS}, c AS (SELECT canonical, count(*) AS n FROM a GROUP BY 1) SELECT DISTINCT name, coalesce(n, 0) AS aliases FROM m LEFT JOIN c ON name = canonical")
def alias_counts(spark, d):
    """J7."""
    counts = aliases(spark, d).groupBy(F.col("canonical").alias("name")).agg(n().alias("aliases"))
    return mentions(spark, d).select("name").distinct().join(counts, "name", "left").select("name", F.coalesce("aliases", F.lit(0)).alias("aliases"))


@register("edge_search", f"WITH {MENTIONS}, e AS (SELECT a.name AS a, b.name AS b, count(DISTINCT u) AS weight FROM m a JOIN m b USING (u) WHERE a.name < b.name GROUP BY 1, 2) SELECT * FROM e WHERE a ILIKE '%N1%' OR b ILIKE '%N1%' ORDER BY weight DESC, a, b LIMIT 50")
def edge_search(spark, d):
    """G6."""
    m = mentions(spark, d).select("u", "name").distinct()
    e = m.withColumnRenamed("name", "a").join(m.withColumnRenamed("name", "b"), "u").where("a < b").groupBy("a", "b").agg(n().alias("weight"))
    return e.where(F.col("a").ilike("%N1%") | F.col("b").ilike("%N1%")).orderBy(F.desc("weight"), "a", "b").limit(50)


@register(
    "evaluation_by_type",
    f"""WITH {MENTIONS}, g AS (SELECT DISTINCT kind, u, name FROM m WHERE start <= 3), p AS (SELECT DISTINCT kind, u, name FROM m WHERE start >= 3),
c AS (SELECT kind, count(*) FILTER (g AND p) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM (SELECT kind, u, name, bool_or(x) AS g, bool_or(NOT x) AS p FROM (SELECT *, TRUE AS x FROM g UNION ALL SELECT *, FALSE FROM p) GROUP BY 1, 2, 3) GROUP BY 1)
SELECT kind, tp, fp, fn, coalesce(round(tp::DOUBLE / nullif(tp + fp, 0), 6), 0) AS precision, coalesce(round(tp::DOUBLE / nullif(tp + fn, 0), 6), 0) AS recall FROM c""",
)
def evaluation_by_type(spark, d):
    """A48."""
    m, keys = mentions(spark, d), ["kind", "u", "name"]
    both = m.where("start <= 3").select(*keys).distinct().withColumn("g", F.lit(True)).join(m.where("start >= 3").select(*keys).distinct().withColumn("p", F.lit(True)), keys, "full_outer")
    count = lambda e: F.count_if(F.expr(e)).cast("bigint")
    out = both.groupBy("kind").agg(count("g and p").alias("tp"), count("p and g is null").alias("fp"), count("g and p is null").alias("fn"))
    rate = lambda whole: F.coalesce(F.round(F.try_divide(F.col("tp").cast("double"), F.expr(whole)), 6), F.lit(0.0))
    return out.withColumn("precision", rate("tp + fp")).withColumn("recall", rate("tp + fn"))


@register("unknown_names", f"WITH {MENTIONS} SELECT DISTINCT name FROM m WHERE name NOT IN (SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey < 15)")
def unknown_names(spark, d):
    """J21."""
    known = table(spark, d, "nation").where("n_nationkey < 15").select(F.concat(F.lit("n"), "n_nationkey").alias("name"))
    return mentions(spark, d).select("name").distinct().join(known, "name", "left_anti")


# --- look-ups ---------------------------------------------------------------------------------------------------


@register(
    "fema_links",
    "WITH e AS (SELECT p_partkey, regexp_extract('DR-' || (4000 + p_partkey % 50) || '-TX', '(\\d{4})', 1) AS f FROM part), x AS (SELECT CAST(4000 + s_suppkey % 40 AS VARCHAR) AS f, max(s_suppkey) AS k FROM supplier GROUP BY 1) SELECT p_partkey, f AS fema_number, s_name AS disaster FROM e JOIN x USING (f) JOIN supplier ON s_suppkey = k",
)
def fema_links(spark, d):
    """The number in a declaration, looked up in a mapping whose last row of a number counts."""
    declared = table(spark, d, "part").select("p_partkey", F.regexp_extract(F.concat(F.lit("DR-"), (F.lit(4000) + F.col("p_partkey") % 50).cast("string"), F.lit("-TX")), "(\\d{4})", 1).alias("fema_number"))
    mapping = table(spark, d, "supplier").groupBy((F.lit(4000) + F.col("s_suppkey") % 40).cast("string").alias("fema_number")).agg(F.max_by("s_name", "s_suppkey").alias("disaster"))
    return declared.join(mapping, "fema_number").select("p_partkey", "fema_number", "disaster")


@register("linked_summary", "SELECT disaster, count(*) AS mentions, count(DISTINCT fema_number) AS numbers FROM (WITH e AS (SELECT p_partkey, CAST(4000 + p_partkey % 50 AS VARCHAR) AS f FROM part), x AS (SELECT CAST(4000 + s_suppkey % 40 AS VARCHAR) AS f, max(s_suppkey) AS k FROM supplier GROUP BY 1) SELECT f AS fema_number, s_name AS disaster FROM e JOIN x USING (f) JOIN supplier ON s_suppkey = k) GROUP BY 1")
def linked_summary(spark, d):
    """A27."""
    return fema_links(spark, d).groupBy("disaster").agg(n().alias("mentions"), F.count_distinct("fema_number").cast("bigint").alias("numbers"))


TAXONOMY = [("1-URGENT", "finance", None), ("2-HIGH", "metrics", "narrative"), ("3-MEDIUM", None, "timeline"), ("5-LOW", "other", None)]


@register("resolved_families", VIEWS + "SELECT coalesce(override, predicted, 'unknown') AS family, count(*) AS n FROM activities LEFT JOIN (VALUES ('1-URGENT', 'finance', NULL), ('2-HIGH', 'metrics', 'narrative'), ('3-MEDIUM', NULL, 'timeline'), ('5-LOW', 'other', NULL)) t(activity_type, predicted, override) USING (activity_type) GROUP BY 1")
def resolved_families(spark, d):
    """A taxonomy's override counts before what was predicted. A literal table of four rows is sent to all tasks."""
    taxonomy = spark.createDataFrame(TAXONOMY, "activity_type string, predicted string, override string")
    return activities(spark, d).join(F.broadcast(taxonomy), "activity_type", "left").groupBy(F.coalesce("override", "predicted", F.lit("unknown")).alias("family")).agg(n().alias("n"))


@register("counties_with_fallback", VIEWS + ", c AS (SELECT program_type, county FROM (SELECT program_type, county, count(*) AS n FROM activities WHERE county IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY program_type ORDER BY n DESC, county) = 1) SELECT coalesce(a.county, CASE WHEN status = 'Completed' THEN c.county END) AS county, count(*) AS n FROM activities a LEFT JOIN c USING (program_type) GROUP BY 1")
def counties_with_fallback(spark, d):
    """A missing county is the most frequent one of its program, where another signal is there."""
    a = activities(spark, d)
    counts = a.where("county is not null").groupBy("program_type", "county").agg(n().alias("k"))
    usual = P.best(counts, ["program_type"], F.desc("k"), "county").select("program_type", F.col("county").alias("usual"))
    filled = F.coalesce("county", F.when(F.col("status") == "Completed", F.col("usual")))
    return a.join(usual, "program_type", "left").groupBy(filled.alias("county")).agg(n().alias("n"))


@register("merged_on_missing_keys", VIEWS + "SELECT county, responsible_org, a.n AS completed, b.n AS under_way FROM (SELECT county, responsible_org, count(*) AS n FROM activities WHERE status = 'Completed' GROUP BY 1, 2) a JOIN (SELECT county AS c, responsible_org AS o, count(*) AS n FROM activities WHERE status = 'Under Way' GROUP BY 1, 2) b ON county IS NOT DISTINCT FROM c AND responsible_org IS NOT DISTINCT FROM o")
def merged_on_missing_keys(spark, d):
    """A missing key equals a missing key."""
    a = activities(spark, d)
    one, two = (a.where(F.col("status") == s).groupBy("county", "responsible_org").agg(n().alias(c)) for s, c in (("Completed", "completed"), ("Under Way", "under_way")))
    same = one["county"].eqNullSafe(two["county"]) & one["responsible_org"].eqNullSafe(two["responsible_org"])
    return one.join(two, same).select(one["county"], one["responsible_org"], "completed", "under_way")


@register("features_with_data", "SELECT n_name AS feature, coalesce(v, 0) AS value, v IS NOT NULL AS matched FROM nation LEFT JOIN (SELECT lower(r_name) AS k, arg_max(r_regionkey, r_regionkey) + 1 AS v FROM region GROUP BY 1 UNION ALL SELECT 'canada', 77) ON lower(n_name) = k")
def features_with_data(spark, d):
    """Features drive; keys are normalised; what has no data is 0."""
    data = table(spark, d, "region").groupBy(R.normal_value(F.col("r_name"), "geoid").alias("k")).agg((F.max_by("r_regionkey", "r_regionkey") + 1).alias("v")).unionByName(spark.createDataFrame([("canada", 77)], "k string, v int"))
    feature = table(spark, d, "nation").select(F.col("n_name").alias("feature"), R.normal_value(F.col("n_name"), "geoid").alias("k"))
    return feature.join(data, "k", "left").select("feature", F.coalesce("v", F.lit(0)).alias("value"), F.col("v").isNotNull().alias("matched"))


@register("funding_of_latest_quarter", VIEWS + "SELECT s_name AS name, round(sum(allocated), 2) AS allocated FROM supplier LEFT JOIN allocations ON s_suppkey = subrecipient_id WHERE quarter = (SELECT max_by(quarter, year * 10 + quarter_num) FROM allocations) GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 20")
def funding_of_latest_quarter(spark, d):
    """A predicate on the right side makes the outer join an inner one; the 20 largest, missing ones last."""
    given = allocations(spark, d)
    latest = given.agg(F.max_by("quarter", F.struct("year", "quarter_num")).alias("quarter"))
    joined = table(spark, d, "supplier").select("s_suppkey", "s_name").join(given.drop("name"), F.col("s_suppkey") == F.col("subrecipient_id"), "left").join(F.broadcast(latest), "quarter")
    return joined.groupBy(F.col("s_name").alias("name")).agg(money("allocated").alias("allocated")).orderBy(F.col("allocated").desc_nulls_last(), "name").limit(20)


@register("zip_progress", VIEWS + "SELECT zip, count(DISTINCT a.activity_code) AS activities, round(sum(h), 2) AS households, count(p) AS with_history FROM (SELECT DISTINCT activity_code, quarter, zip FROM allocations) a JOIN (SELECT DISTINCT activity_code, quarter FROM activities WHERE status = 'Completed') c USING (activity_code, quarter) LEFT JOIN (SELECT activity_code, quarter, sum(households) AS h FROM allocations GROUP BY 1, 2) b USING (activity_code, quarter) LEFT JOIN (SELECT activity_code, min(quarter) AS p FROM activities WHERE status = 'Cancelled' GROUP BY 1) x USING (activity_code) GROUP BY 1")
def zip_progress(spark, d):
    """Activity and ZIP, then beneficiaries, then history."""
    given, keys = allocations(spark, d), ["activity_code", "quarter"]
    a = activities(spark, d)
    chain = given.select(*keys, "zip").distinct().join(a.where("status = 'Completed'").select(*keys).distinct(), keys)
    chain = chain.join(given.groupBy(*keys).agg(F.sum("households").alias("h")), keys, "left").join(a.where("status = 'Cancelled'").groupBy("activity_code").agg(F.min("quarter").alias("p")), "activity_code", "left")
    return chain.groupBy("zip").agg(F.count_distinct("activity_code").cast("bigint").alias("activities"), money("h").alias("households"), F.count("p").cast("bigint").alias("with_history"))
