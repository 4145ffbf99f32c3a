"""Operators over documents: lines, sections, snippets, keywords, quality, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T

PAGE_BREAK = "\n\n--- PAGE BREAK ---\n\n"


def page_text(pages: DataFrame, key: str = "document_id", page: str = "page_number", text: str = "text_content") -> DataFrame:
    """One text a document: its pages in order, empty ones left out."""
    some = pages.where(F.col(text).isNotNull() & (F.col(text) != ""))
    ordered = F.array_sort(F.collect_list(F.struct(page, text)))
    return some.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x[text]), PAGE_BREAK).alias(text))


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def heading(line) -> tuple:
    """(is heading, method): a 'Label:' line, all capitals, or title case; short lines without amounts only."""
    letters = F.length(F.regexp_replace(line, "[^A-Za-z]", ""))
    capitals = F.length(F.regexp_replace(line, "[^A-Z]", ""))
    tokens = T.words(line)
    titled = F.size(F.filter(tokens, lambda w: w.rlike("^[A-Z]")))
    fits = (F.length(line) <= 90) & (F.length(line) > 0) & ~line.rlike("\\$[0-9]{2}")
    method = (
        F.when(line.rlike("^[A-Za-z][A-Za-z /&-]{2,60}:$"), "colon")
        .when((letters >= 4) & (capitals >= 0.9 * letters), "all_caps")
        .when((F.size(tokens) >= 2) & (titled >= 0.9 * F.size(tokens)) & ~line.rlike("[.!?,;]$"), "title")
    )
    return F.coalesce(fits & method.isNotNull(), F.lit(False)), F.when(fits, method)


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of lines from one heading to the next; lines before the first heading are section 0,
    'Document'. A line is a heading by its form, and only behind a blank line or at the start."""
    found = lines(docs, key, text).withColumn("line", F.trim("line"))
    order = Window.partitionBy(key).orderBy("line_no")
    is_heading, method = heading(F.col("line"))
    found = found.withColumn("after_blank", F.lag(F.col("line") == "", 1, True).over(order))
    found = found.withColumn("is_heading", is_heading & (F.col("after_blank") | (method == "colon"))).withColumn("method", method)
    found = found.withColumn("section_index", F.sum(F.col("is_heading").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.struct("line_no", "line", "is_heading", "method")
    out = found.groupBy(key, "section_index").agg(
        F.min(first).alias("f"), F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.count(F.lit(1)).cast("bigint").alias("n_lines"), F.sum(F.length("line")).cast("bigint").alias("n_chars")
    )
    named = F.when(F.col("f.is_heading"), F.col("f.line")).otherwise("Document")
    how = F.when(F.col("f.is_heading"), F.col("f.method")).otherwise("implicit")
    return out.select(key, F.col("section_index").cast("bigint").alias("section_index"), named.alias("heading"), how.alias("method"), "start_line", "end_line", "n_lines", "n_chars")


def snippets(docs: DataFrame, pattern: str, around: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines that match, with the lines around them."""
    near = Window.partitionBy(key).orderBy("line_no").rowsBetween(-around, around)
    found = lines(docs, key, text).withColumn("snippet", F.array_join(F.collect_list("line").over(near), " "))
    return found.where(F.col("line").rlike(pattern)).select(key, "line_no", "snippet")


def keyword_hits(docs: DataFrame, keywords: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that hold each keyword, whatever the case: one pass over the texts for all keywords."""
    found = docs.select(key, F.explode(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower(F.col(text)), F.lower(k)))).alias("keyword"))
    return found.groupBy("keyword").agg(F.count(F.lit(1)).cast("bigint").alias("documents"))


def good_chunks(docs: DataFrame, least: int = 200, most_digits: float = 0.15, boilerplate: tuple[str, ...] = (), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows worth modelling: long enough, few digits, and no boilerplate phrase."""
    c = F.col(text)
    ok = (F.length(c) >= least) & (F.coalesce(T.digit_ratio(c), F.lit(1.0)) <= most_digits)
    for phrase in boilerplate:
        ok = ok & ~F.contains(F.lower(c), F.lit(phrase.lower()))
    return docs.where(ok)


#: Patterns that are sent to every task at once.
PATTERNS = 4096


def substring_join(docs: DataFrame, patterns: DataFrame, text: str, pattern: str) -> DataFrame:
    """Each row with every pattern that its text holds, whatever the case. A pattern may stand anywhere, so there is no
    key to join by: patterns go to all tasks, in blocks of at most PATTERNS, and each block passes over the rows."""
    parts = max(1, -(-patterns.count() // PATTERNS))
    out = None
    for part in range(parts):
        block = patterns if parts == 1 else patterns.where(F.pmod(F.xxhash64(pattern), F.lit(parts)) == part)
        found = docs.join(F.broadcast(block), F.contains(F.lower(F.col(text)), F.lower(F.col(pattern))))
        out = found if out is None else out.unionByName(found)
    return out


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Targets of a page's links, without query and fragment; '' left out."""
    found = pages.select(key, F.explode(F.regexp_extract_all(html, F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))).alias("target"))
    return found.select(key, F.regexp_replace("target", "[?#].*$", "").alias("target")).where("target <> ''")


def capitalised(docs: DataFrame, pattern: str = "[A-Z][a-z]{5,}", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of capitalised words as entities: key, start, end, entity_text."""
    return docs.select(key, F.inline(T.spans(F.col(text), pattern))).withColumnRenamed("text", "entity_text")


def names(docs: DataFrame, pattern: str = "[A-Z][a-z]{5,}", key: str = "doc_id", text: str = "text") -> DataFrame:
    """As capitalised, without offsets: key, start (the match's number in the text), entity_text."""
    return docs.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))).alias("start", "entity_text"))


def in_sentences(docs: DataFrame, pattern: str = "[A-Z][a-z]{5,}", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Matches inside each sentence: key, sentence (its number from 0), start (the match's number in it), entity_text.

    Sentences are those of T.sentences."""
    cut = docs.select(key, F.posexplode(F.split(F.col(text), T.SENTENCE_END, -1)).alias("sentence", "_s"))
    return cut.select(key, "sentence", F.posexplode(F.regexp_extract_all("_s", F.lit(f"({pattern})"), F.lit(1))).alias("start", "entity_text"))
