"""Registered queries over long tables by quarter, and over what a corpus holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern import registry
from quern.functions import rules as R
from quern.operators import documents as docs_
from quern.operators import quarters as Q
from quern.plans import structures
from quern.plans.texts import LINES, SECTIONS
from quern.registry import register
from quern.sources.tables import table

#: An order is a document; its line items are mentions, of which every fifth part's have no readable value.
_DOCS = "d AS (SELECT o_orderkey AS document_id, o_orderpriority AS category, CASE WHEN o_custkey % 3 > 0 THEN 'D' || (o_custkey % 3) END AS disaster_code, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter FROM orders)"
_MENTIONS = """m AS (SELECT l_orderkey AS document_id, l_linenumber % 3 AS kind, l_partkey % 5 = 0 AS bad, CAST(l_quantity AS INTEGER) AS q FROM lineitem)"""
_GROUP = ", ".join(Q.GROUP)


def _docs(spark, d):
    code = F.when(F.col("o_custkey") % 3 > 0, F.concat(F.lit("D"), F.col("o_custkey") % 3))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("category"), code.alias("disaster_code"), F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"))


def _mentions(spark, d):
    kind, q = F.col("l_linenumber") % 3, F.col("l_quantity").cast("int").cast("string")
    text = F.when(F.col("l_partkey") % 5 == 0, "none").when(kind == 0, F.concat(q, F.lit(".5 In of rain"))).when(kind == 1, F.concat(q, F.lit("MPH"))).otherwise(F.concat(F.lit("FEMA-4"), F.lpad(q, 3, "0"), F.lit("-DR")))
    named = F.when(kind == 0, "RAINFALL").when(kind == 1, "WIND_SPEED").otherwise("FEMA_DECLARATION")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), named.alias("entity_type"), text.alias("entity_text"))


@register("entities_by_quarter", f"WITH {_DOCS}, {_MENTIONS} SELECT {_GROUP}, ['RAINFALL', 'WIND_SPEED', 'FEMA_DECLARATION'][kind + 1] AS entity_type, count(*) AS n_mentions FROM m JOIN d USING (document_id) GROUP BY ALL")
def entities_by_quarter(spark, d):
    """N6, A25."""
    return Q.entities(_mentions(spark, d), _docs(spark, d))


@register(
    "severity_by_quarter",
    f"WITH {_DOCS}, {_MENTIONS} SELECT {_GROUP}, CASE kind WHEN 0 THEN 'rainfall_inches' ELSE 'wind_speed_mph' END AS metric, count(*) AS n_mentions, max(CASE WHEN NOT bad THEN q + CASE kind WHEN 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END END) AS max_value FROM m JOIN d USING (document_id) WHERE kind < 2 GROUP BY ALL",
)
def severity_by_quarter(spark, d):
    """N6."""
    return Q.severity(_mentions(spark, d), _docs(spark, d))


@register("declarations_by_quarter", f"WITH {_DOCS}, {_MENTIONS} SELECT {_GROUP}, 4000 + q AS fema_number, count(*) AS n_mentions, count(DISTINCT document_id) AS n_documents FROM m JOIN d USING (document_id) WHERE kind = 2 AND NOT bad GROUP BY ALL")
def declarations_by_quarter(spark, d):
    """N6."""
    return Q.declarations(_mentions(spark, d), _docs(spark, d))


_KEYWORDS = ("the", "License", "ing and", "no such words")


@register(
    "keyword_pages_by_quarter",
    f"WITH {_DOCS}, {LINES} SELECT k AS keyword, {_GROUP}, count(*) AS n_pages, count(DISTINCT document_id) AS n_documents FROM l JOIN d ON doc_id = document_id, (VALUES {', '.join(f'({chr(39)}{k}{chr(39)})' for k in _KEYWORDS)}) v(k) WHERE contains(lower(line), lower(k)) GROUP BY ALL",
)
def keyword_pages_by_quarter(spark, d):
    """A document's lines are its pages, its date that of the order of its number."""
    pages = docs_.lines(table(spark, d, "documents")).select(F.col("doc_id").alias("document_id"), F.col("line").alias("text"))
    return Q.keyword_pages(pages, _docs(spark, d), list(_KEYWORDS))


@register("topics_by_quarter", f"WITH {_DOCS}, t AS ({registry._oracles['topic_terms']}) SELECT t.source AS topic, label, {_GROUP}, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_documents FROM documents x JOIN t ON x.source = t.source JOIN d ON doc_id = document_id GROUP BY ALL")
def topics_by_quarter(spark, d):
    """A source's documents are a topic, labelled by its terms."""
    assigned = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("topic"))
    return Q.topics(assigned, structures.topic_terms(spark, d).withColumnRenamed("source", "topic"), _docs(spark, d))


_TEXT = "trim(regexp_replace(heading, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"
_KNOWN = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.HEADINGS.items())
_WORDS = " ".join(f"WHEN regexp_matches(norm, '{p}') THEN '{name}'" for name, _, p in R.FAMILIES)
_FAMILIES = f"""WITH s AS ({SECTIONS}), h AS (SELECT doc_id, lower(trim(regexp_replace({_TEXT}, ':+$', ''))) AS norm FROM s),
f AS (SELECT doc_id, norm, CASE WHEN norm = '' THEN 'other' WHEN {" OR ".join(f"contains(norm, '{x}')" for x in R.RUNNING_HEADS)} THEN 'boilerplate' ELSE coalesce(CASE norm {_KNOWN} END, CASE WHEN norm LIKE '% type' OR norm LIKE '% types' THEN 'metadata' {_WORDS} ELSE 'other' END) END AS family FROM h)
SELECT family, count(*) AS sections, count(DISTINCT doc_id) AS documents, count(DISTINCT norm) AS headings FROM f GROUP BY 1"""


@register("section_families", _FAMILIES)
def section_families(spark, d):
    """Sections, documents and different headings of each family of headings."""
    found = docs_.sections(table(spark, d, "documents")).select("doc_id", F.lower(F.trim(F.regexp_replace(R.squeezed(F.col("heading")), ":+$", ""))).alias("norm"), R.heading_family(F.col("heading"))["family"].alias("family"))
    each = found.groupBy("family", "norm", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("family").agg(F.sum("n").alias("sections"), F.count_distinct("doc_id").alias("documents"), F.count_distinct("norm").alias("headings"))


_HELD = ("documents", "pages", "benchmark", "labels", "conversations", "embeddings", "orders", "lineitem")


@register(
    "overview",
    " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, NULL::INTEGER AS year, NULL::INTEGER AS quarter FROM {t}" for t in _HELD)
    + " UNION ALL SELECT * FROM (SELECT 'latest' AS name, NULL::BIGINT AS n, CAST(year(o_orderdate) AS INTEGER), CAST(quarter(o_orderdate) AS INTEGER) FROM orders WHERE o_orderdate IS NOT NULL ORDER BY o_orderdate DESC LIMIT 1)",
)
def overview(spark, d):
    """What each table holds, and the latest quarter of orders."""
    none = F.lit(None).cast("int")
    own = [table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n", none.alias("year"), none.alias("quarter")) for t in _HELD]
    last = table(spark, d, "orders").agg(F.max("o_orderdate").alias("at")).where("at IS NOT NULL").select(F.lit("latest").alias("name"), F.lit(None).cast("bigint").alias("n"), F.year("at").alias("year"), F.quarter("at").alias("quarter"))
    for one in own[1:]:
        own[0] = own[0].unionByName(one)
    return own[0].unionByName(last)
