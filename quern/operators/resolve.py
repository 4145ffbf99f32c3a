"""Aliases, frequency lists, co-occurrence edges and their evidence, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import rules as R
from quern.functions import text as T
from quern.operators.pages import BIN, bins


def aliases(mentions: DataFrame, text: str = "entity_text", least: int = 1, keep: Column | None = None) -> DataFrame:
    """alias, key, canonical: of all spellings with one key the most frequent is canonical, ties to the smaller.
    Of keep, a condition on the text, every spelling is judged once."""
    n = mentions.groupBy(text).agg(F.count(F.lit(1)).cast("bigint").alias("n")).where(F.col("n") >= least)
    n = n if keep is None else n.where(F.when(F.col("n") > 0, keep))
    keyed = n.withColumn("key", T.normalize_key(F.col(text))).where("key <> ''")
    rank = F.first(text).over(Window.partitionBy("key").orderBy(F.desc("n"), text))
    return keyed.select(F.col(text).alias("alias"), "key", rank.alias("canonical"), "n")


def resolved(mentions: DataFrame, known: DataFrame, text: str = "entity_text") -> DataFrame:
    """Mentions with their canonical text, or their own where no alias is known."""
    names = known.select(F.col("alias").alias(text), "canonical")
    return mentions.join(names, text, "left").withColumn("canonical", F.coalesce("canonical", text))


def frequent(mentions: DataFrame, column: str, least: int) -> DataFrame:
    """Rows whose value occurs often enough."""
    keep = mentions.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(column)
    return mentions.join(keep, column, "left_semi")


def inside(spans: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Spans (start, end) inside windows (w_start, w_end) of the same key. A span lies in the bin of its start, a window in
    all bins from its start to its end, so that what meets grows with the spans and windows and not with their product."""
    spans = spans.where("start <= end").withColumn("_bin", F.floor(F.col("start") / BIN))
    windows = windows.withColumn("_bin", F.explode(bins("w_start", "w_end")))
    return spans.join(windows, [key, "_bin"]).where("start >= w_start and end <= w_end").drop("_bin")


def edges(mentions: DataFrame, unit: list[str], name: str, most_a_unit: int = 5, least_weight: int = 3) -> DataFrame:
    """Pairs of names that share a unit (a sentence, a line): at most the first few names of a unit,
    the smaller name first, with the number of units."""
    first = mentions.groupBy(*unit, name).agg(F.min("start").alias("start"))
    rank = F.row_number().over(Window.partitionBy(*unit).orderBy("start", name))
    few = first.withColumn("_rank", rank).where(F.col("_rank") <= most_a_unit).select(*unit, name)
    a, b = few.withColumnRenamed(name, "subject"), few.withColumnRenamed(name, "object")
    pairs = a.join(b, unit).where("subject < object")
    return pairs.groupBy("subject", "object").agg(F.count(F.lit(1)).cast("bigint").alias("weight")).where(F.col("weight") >= least_weight)


def evidence(rows: DataFrame, key: list[str], order: list[str], most: int = 2) -> DataFrame:
    """The first rows of each key, in order."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= most)


def scores(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of distinct keys; 0 where nothing is divided by."""
    g = gold.select(*keys).distinct().withColumn("g", F.lit(True))
    p = predicted.select(*keys).distinct().withColumn("p", F.lit(True))
    both = g.join(p, keys, "full_outer").agg(F.count_if(F.expr("g and p")).alias("tp"), F.count_if(F.expr("p and g is null")).alias("fp"), F.count_if(F.expr("g and p is null")).alias("fn"))
    rate = lambda a, b: F.coalesce(F.round(F.try_divide(a.cast("double"), b), 6), F.lit(0.0))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return both.select("tp", "fp", "fn", rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"))


def organisations(mentions: DataFrame, text: str = "entity_text", seeds: tuple[str, ...] = (), candidates: bool = True) -> DataFrame:
    """Mentions that are no noise of forms, and, for aliases, that may name an organisation at all. Seeds always stay.

    Each different text is judged once, whatever the number of its mentions. The count in the condition is never 0: it
    keeps the optimizer from moving the rules below the grouping, back to the mentions."""
    names = mentions.groupBy(text).agg(F.count(F.lit(1)).alias("_n"))
    kept = names.where(F.when(F.col("_n") > 0, _is_org(text, seeds, candidates)))
    return mentions.join(kept.select(text), text, "left_semi")


def _is_org(text: str, seeds: tuple[str, ...], candidates: bool) -> Column:
    keep = ~R.is_noise_org(F.col(text))
    keep = keep & R.is_org_candidate(F.col(text), seeds) if candidates else keep
    return keep | F.col(text).isin(*seeds) if seeds else keep


def org_aliases(mentions: DataFrame, text: str = "entity_text", least: int = 2, seeds: tuple[str, ...] = ()) -> DataFrame:
    """alias, key, canonical, n: aliases of spellings that occur `least` times and may name an organisation. Of one key a
    seed is canonical, the first by name if there are several; else the most frequent spelling."""
    found = aliases(mentions, text, least, _is_org(text, seeds, True))
    if not seeds:
        return found
    first = F.min(F.when(F.col("alias").isin(*seeds), F.col("alias"))).over(Window.partitionBy("key"))
    return found.withColumn("canonical", F.coalesce(first, "canonical"))
