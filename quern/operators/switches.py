"""Statements that funds were switched, with a page's organisations and amounts, and their summary by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import forms
from quern.functions import rules as R
from quern.functions import text as T

#: Names too common to tell pages apart, how many names a page keeps, labels of amounts, lengths. Fixed values.
GENERIC = ("Community Development Systems", "Disaster Recovery Grant Reporting System", "DRGR", "HUD")
ORGS, LABELS, SNIPPET, AROUND = 12, ("budget", "obligated", "drawdown", "expended", "unknown"), 1200, 2
PAGE = ["document_id", "page_number"]


def _once(df: DataFrame, name: str, made: Column) -> DataFrame:
    """df and a column whose null rows go. It is made once: a filter on a plain column would be put before it, made of
    the same parts, and what joins on a part of them would get it too."""
    return df.select("*", F.explode_outer(F.array(made)).alias(name)).where(F.col(name).isNotNull())


def top_orgs(mentions: DataFrame) -> DataFrame:
    """orgs, a page's most frequent organisations, from mentions (document_id, page_number, entity_text,
    normalized_text); ties by name. Counts come before the ranks, so a page's repeats do not gather in one task."""
    org = T.let(R.squeezed(F.coalesce("normalized_text", "entity_text")), lambda x: F.when(F.length(x).between(3, 80) & ~x.isin(*GENERIC), x))
    counted = _once(mentions, "org", org).groupBy(*PAGE, "org").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("n"), "org"))
    kept = counted.withColumn("place", place).where(F.col("place") <= ORGS)
    return kept.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "org"))), lambda x: x["org"]).alias("orgs"))


def money_by_page(mentions: DataFrame) -> DataFrame:
    """Number, sum and largest of a page's amounts by label, from mentions (document_id, page_number, context_label,
    amount_usd). No label is 'unknown'; labels beyond LABELS are left out."""
    label = F.coalesce("context_label", F.lit("unknown"))
    one = lambda name: F.when(label == name, F.col("amount_usd"))
    made = [(F.count(F.when(label == x, 1)).alias(f"money_n_{x}"), F.round(F.sum(one(x)), 2).alias(f"money_sum_{x}"), F.max(one(x)).alias(f"money_max_{x}")) for x in LABELS]
    return mentions.groupBy(*PAGE).agg(*[c for three in made for c in three])


def statements(pages: DataFrame, orgs: DataFrame, money: DataFrame | None = None) -> DataFrame:
    """A row for each different statement of a page (document_id, page_number, text): a line with a keyword and the two
    lines before and after it. Blank lines do not count; what differs in case alone is one statement. orgs as `top_orgs`
    gives them, money as `money_by_page`; a page without either has none (zeros). Null texts have no statements."""
    initials = "".join(sorted({k[0] for k, _ in R.SWITCHES}))
    words = f"(?i)(?=[{initials}])(?:" + "|".join(p for _, p in R.SWITCHES) + ")"

    def cut(own):
        around = lambda i: F.array_join(F.slice(own, F.greatest(i - AROUND, F.lit(0)) + 1, F.least(i, F.lit(AROUND)) + AROUND + 1), " ")
        return F.filter(F.transform(own, lambda line, i: F.when(line.rlike(words), R.squeezed(around(i)))), lambda s: s.isNotNull())

    def different(found):
        return T.let(F.transform(found, F.lower), lambda low: F.filter(found, lambda _, i: F.array_position(low, F.get(low, i)) == i + 1))

    lines = pages.select(*PAGE, F.when(F.col("text").rlike(words), forms.page_lines(F.col("text"))).alias("lines"))
    snippets = lines.select(*PAGE, F.explode_outer(T.let(cut(F.col("lines")), different)).alias("snippet_full")).where("snippet_full IS NOT NULL")
    known = snippets.join(orgs, PAGE, "left").withColumn("orgs", F.coalesce("orgs", F.array().cast("array<string>")))
    scored = _once(known, "x", T.let(R.fund_switch(F.col("snippet_full"), F.size("orgs")), lambda x: F.when(x["keyword"].isNotNull(), x)))
    out = scored.select(
        *PAGE, "x.keyword", "x.score", "x.confidence", F.col("x.from").alias("from_text"), F.col("x.to").alias("to_text"), F.lower("snippet_full").rlike(R.REASON).alias("has_justification_cue"),
        F.size("orgs").alias("n_orgs_on_page"), F.when(F.size("orgs") > 0, F.array_join("orgs", "; ")).alias("orgs_on_page"), forms.shortened(F.col("snippet_full"), SNIPPET).alias("snippet"), "snippet_full",
        forms.core_statement(F.col("snippet_full"), F.col("x.keyword")).alias("core"),
    )
    if money is None:
        return out
    amounts = [c for c in money.columns if c not in PAGE]
    return out.join(money, PAGE, "left").select(*out.columns, *[F.coalesce(c, F.lit(0).cast(money.schema[c].dataType)).alias(c) for c in amounts])


def document_summary(found: DataFrame) -> DataFrame:
    """Statements of each document by confidence."""
    level = lambda name: F.count(F.when(F.col("confidence") == name, 1)).alias(f"n_{name}")
    return found.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_hits"), *map(level, ("high", "medium", "low")))
