"""Long tables by category, disaster code, year and quarter of the documents: entities, severity, declarations, keywords,
topics. Counts are made a document before documents are joined, so what is shuffled then is a row for each document and
value; a null in a group's key is a group of its own, rows without a document fall out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import extract

GROUP = ["category", "disaster_code", "year", "quarter"]
#: Measures of severity: type of entity, and how its value is written. Fixed values.
SEVERITY = {"rainfall_inches": ("RAINFALL", "(?i)([0-9]+(?:\\.[0-9]+)?)\\s*in\\b"), "wind_speed_mph": ("WIND_SPEED", "(?i)([0-9]+(?:\\.[0-9]+)?)\\s*mph\\b")}


def _by_document(rows: DataFrame, docs: DataFrame, *names: str, **more) -> DataFrame:
    """Rows counted by document and names (n), with what `more` makes of them, and each document's group."""
    counted = rows.groupBy("document_id", *names).agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in more.items()])
    return counted.join(docs.select("document_id", *GROUP), "document_id")


def entities(mentions: DataFrame, docs: DataFrame) -> DataFrame:
    """Mentions (document_id, entity_type) by group and type."""
    return _by_document(mentions, docs, "entity_type").groupBy(*GROUP, "entity_type").agg(F.sum("n").alias("n_mentions"))


def severity(mentions: DataFrame, docs: DataFrame) -> DataFrame:
    """Mentions of rain and wind (document_id, entity_type, entity_text) by group, and the largest value that is read;
    a text without a value counts as a mention."""
    metric, value = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, (kind, pattern) in SEVERITY.items():
        metric = F.when(F.col("entity_type") == kind, name).otherwise(metric)
        value = F.when(F.col("entity_type") == kind, extract(F.col("entity_text"), pattern).cast("double")).otherwise(value)
    known = mentions.select("document_id", metric.alias("metric"), value.alias("value")).where("metric IS NOT NULL")
    return _by_document(known, docs, "metric", most=F.max("value")).groupBy(*GROUP, "metric").agg(F.sum("n").alias("n_mentions"), F.max("most").alias("max_value"))


def declarations(mentions: DataFrame, docs: DataFrame) -> DataFrame:
    """Declarations by group and their number of four digits; texts without one are left out."""
    known = mentions.where("entity_type = 'FEMA_DECLARATION'").select("document_id", extract(F.col("entity_text"), "(\\d{4})").cast("int").alias("fema_number")).where("fema_number IS NOT NULL")
    return _by_document(known, docs, "fema_number").groupBy(*GROUP, "fema_number").agg(F.sum("n").alias("n_mentions"), F.count(F.lit(1)).alias("n_documents"))


def keyword_pages(pages: DataFrame, docs: DataFrame, keywords: list[str]) -> DataFrame:
    """Pages (document_id, text) that hold a keyword, whatever its case, and their documents; texts are read once."""
    held = F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower("text"), F.lower(k)))
    return _by_document(pages.select("document_id", F.explode(held).alias("keyword")), docs, "keyword").groupBy("keyword", *GROUP).agg(F.sum("n").alias("n_pages"), F.count(F.lit(1)).alias("n_documents"))


def topics(assigned: DataFrame, labels: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks (document_id, topic) by topic and group, with the topic's label (topic, label)."""
    counted = _by_document(assigned, docs, "topic").groupBy("topic", *GROUP).agg(F.sum("n").alias("n_chunks"), F.count(F.lit(1)).alias("n_documents"))
    return counted.join(labels.select("topic", "label"), "topic")
