"""Operators over ordered pages, lines and intervals: groups, paragraphs, precedence of ranges, best keys, links."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T


def best(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def page_groups(pages: DataFrame, is_header: Column, key: str = "document_id", page: str = "page_number") -> DataFrame:
    """Pages with header_page: a group runs from a header page to the next one; pages before the first header go."""
    before = Window.partitionBy(key).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("header_page", F.max(F.when(is_header, F.col(page))).over(before)).where("header_page is not null")


#: Positions are cut into bins of this width, and ranges meet only where they share one.
BIN = 1024


def bins(start, end) -> Column:
    """The bins of positions from start to end, both included; one bin at least; null if either is."""
    start, end = (F.floor((F.col(x) if isinstance(x, str) else x) / BIN) for x in (start, end))
    return F.sequence(start, F.greatest(start, end))


def overlapping(rows: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Rows (start, end) that overlap any span (s_start, s_end) of their key. A span does not end before it begins."""
    own = rows.withColumn("_row", F.monotonically_increasing_id())
    own = own.withColumn("_bin", F.explode(bins("start", F.col("end") - 1)))
    spans = spans.select(key, "s_start", "s_end", F.explode(bins("s_start", F.col("s_end") - 1)).alias("_bin"))
    on = (F.col(f"r.{key}") == F.col(f"s.{key}")) & (F.col("r._bin") == F.col("s._bin")) & (F.col("s.s_start") < F.col("r.end")) & (F.col("s.s_end") > F.col("r.start"))
    return own.alias("r").join(spans.alias("s"), on, "left_semi").dropDuplicates(["_row"]).drop("_row", "_bin")


def covering(points: DataFrame, spans: DataFrame, key: str, point: list[str], at: str) -> DataFrame:
    """Points with the first span that covers them, one with a section before one without; null if there is none."""
    points = points.withColumn("_bin", F.floor(F.col(at) / BIN))
    spans = spans.where("s_start < s_end").withColumn("_bin", F.explode(bins("s_start", F.col("s_end") - 1)))
    on = (F.col(f"p.{key}") == F.col(f"s.{key}")) & (F.col("p._bin") == F.col("s._bin")) & (F.col("s.s_start") <= F.col(f"p.{at}")) & (F.col(f"p.{at}") < F.col("s.s_end"))
    met = points.alias("p").join(spans.alias("s"), on, "left").select("p.*", "s.s_start", "s.s_end", "s.section_id").drop("_bin")
    return best(met, point, F.col("section_id").isNull(), F.col("s_start").asc_nulls_last(), F.col("s_end").asc_nulls_last(), F.col("section_id").asc_nulls_last())


def headings_of_pages(sections: DataFrame, key: str = "document_id") -> DataFrame:
    """key, page, heading: of the sections (start_page, end_page, ord) over a page the one that starts last; ties by ord, heading."""
    pages = sections.select(key, F.explode(F.sequence("start_page", "end_page")).alias("page"), "start_page", "ord", "heading")
    return pages.groupBy(key, "page").agg(F.max_by("heading", F.struct("start_page", "ord", "heading")).alias("heading"))


#: What a list item begins with, and what a sentence ends with. Fixed values.
BULLET, ENDS = "^(?:[\\u2022\\-*]|(?:\\(?\\d+\\)?[.)]))\\s+", "[.!?]$"


def paragraphs(lines: DataFrame, key: str = "doc_id", order: str = "line_no", line: str = "line", long: int = 900) -> DataFrame:
    """key, paragraph (from 0), start_line, end_line, text: a blank line ends a paragraph, a bullet begins one, and one of
    `long` characters or more ends with a line that ends a sentence. Where a paragraph ends depends on where it began, so
    one document's lines are gone through in order, once; a null line is blank."""
    own = F.array_sort(F.collect_list(F.struct(F.col(order).cast("int").alias("n"), F.coalesce(F.trim(F.regexp_replace(line, "[ \\t\\r\\f\\x0B]+", " ")), F.lit("")).alias("t"))))
    bullet, ends = re.compile(BULLET, re.ASCII), re.compile(ENDS)

    def cut(rows) -> list[tuple[int, int, str]]:
        done, first, last, parts, size = [], 0, 0, [], 0
        for n, t in ((r["n"], r["t"]) for r in rows):
            if parts and (not t or bullet.search(t)):
                done.append((first, last, " ".join(parts)))
                parts = []
            if not t:
                continue
            first, size = (first, size + 1 + len(t)) if parts else (n, len(t))
            parts.append(t)
            last = n
            if size >= long and ends.search(t):
                done.append((first, last, " ".join(parts)))
                parts = []
        return [*done, (first, last, " ".join(parts))] if parts else done

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, i, *p) for k, rows in zip(b[key], b["l"], strict=True) for i, p in enumerate(cut(rows))]
            yield pd.DataFrame(out, columns=[key, "paragraph", "start_line", "end_line", "text"])

    kind = dict(lines.dtypes)[key]
    return lines.groupBy(key).agg(own.alias("l")).mapInPandas(run, f"{key} {kind}, paragraph int, start_line int, end_line int, text string")


def section_text(lines: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Text of each span (start_line, end_line, heading) of lines, without a first line that is the heading itself."""
    lines = lines.withColumn("_bin", F.floor(F.col("line_no") / BIN))
    spans = spans.where("start_line <= end_line").withColumn("_bin", F.explode(bins("start_line", "end_line")))
    on = (F.col(f"l.{key}") == F.col(f"s.{key}")) & (F.col("l._bin") == F.col("s._bin")) & F.col("l.line_no").between(F.col("s.start_line"), F.col("s.end_line"))
    kept = lines.alias("l").join(spans.alias("s"), on).where(~((F.col("l.line_no") == F.col("s.start_line")) & (F.trim("l.line") == F.col("s.heading"))))
    ordered = F.array_sort(F.collect_list(F.struct("l.line_no", "l.line")))
    return kept.groupBy(f"s.{key}", "s.section_index").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def capped_by_type(mentions: DataFrame, unit: list[str], kind: str, text: str, a_type: int = 5, least: int = 2, most: int = 12) -> DataFrame:
    """Distinct mentions of a unit: the first `a_type` of each type; units with fewer than `least` or more than `most` go."""
    first = mentions.groupBy(*unit, kind, text).agg(F.min("start").alias("start"))
    few = first.withColumn("_rank", F.row_number().over(Window.partitionBy(*unit, kind).orderBy("start", text))).where(F.col("_rank") <= a_type)
    return few.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*unit))).where(F.col("_n").between(least, most)).drop("_rank", "_n")


def typed_edges(mentions: DataFrame, unit: list[str], kind: str, text: str, order: list[str], allowed: list[tuple[str, str]], least_weight: int = 1) -> DataFrame:
    """Edges between mentions of a unit whose types are an allowed pair, the type that comes first as the source."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(kind))
    own = mentions.withColumn("_rank", rank)
    a, b = (own.select(*unit, *(F.col(c).alias(s + c) for c in (kind, text, "_rank"))) for s in "ab")
    pair = F.concat_ws(">", f"a{kind}", f"b{kind}").isin(*(f"{x}>{y}" for x, y in allowed))
    pairs = a.join(b, unit).where(F.struct("a_rank", f"a{text}") < F.struct("b_rank", f"b{text}")).where(pair)
    out = pairs.groupBy(F.col(f"a{kind}").alias("source_type"), F.col(f"a{text}").alias("source"), F.col(f"b{kind}").alias("target_type"), F.col(f"b{text}").alias("target"))
    return out.agg(F.count(F.lit(1)).cast("bigint").alias("weight")).where(F.col("weight") >= least_weight)


#: What ends a line. Fixed values.
LINE_END = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x85\\u2028\\u2029]"


def line_offsets(pages: DataFrame, key: list[str], raw: str, clean: str) -> DataFrame:
    """key, line_no, start, end, aligned: where each line of the raw text stands in the clean text (code points from 0).

    Lines are cleaned one by one and joined by a space, empty ones left out; an empty line has an empty span where it
    would stand. If what comes out is the clean text, its lines are aligned; if not, each line has the whole clean text
    as its span. A null or empty raw text has no lines, and a null clean text is empty. key is distinct.

    The comparison is made page by page before lines are apart, so a line's row holds no text but its length."""
    lines = F.transform(F.split(raw, LINE_END, -1), lambda x: T.clean_text(x))
    cut = pages.select(*key, F.coalesce(clean, F.lit("")).alias("_clean"), F.when(F.element_at(F.split(raw, LINE_END, -1), -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines).alias("_lines"))
    joined = F.array_join(F.filter("_lines", lambda x: x != ""), " ")
    cut = cut.select(*key, F.length("_clean").alias("_length"), ((joined == F.col("_clean")) & (joined != "")).alias("aligned"), F.transform("_lines", F.length).alias("_sizes"))
    cut = cut.select(*key, "_length", "aligned", F.posexplode("_sizes").alias("line_no", "_n"))  # what stands beside a generator is computed for each of its rows
    step = F.when(F.col("_n") > 0, F.col("_n") + 1).otherwise(0)
    upto = F.sum(step).over(Window.partitionBy(*key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)) - step
    # an empty line stands behind the text so far, before the space that a next line brings
    start = F.when(F.col("_n") > 0, F.col("_upto")).otherwise(F.greatest(F.col("_upto") - 1, F.lit(0)))
    found = cut.withColumn("_upto", upto).withColumn("_start", start)
    return found.select(*key, "line_no", F.when(F.col("aligned"), F.col("_start")).otherwise(0).cast("long").alias("start"), F.when(F.col("aligned"), F.col("_start") + F.col("_n")).otherwise(F.col("_length")).cast("long").alias("end"), "aligned")
