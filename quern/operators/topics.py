"""What topics are about: their terms of the largest mean weight, from a bounded vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.stages import cut

#: Common English words that are no terms. Fixed values.
STOP = tuple(
    "about above after again all also and any are been before being below between both but can could did does doing down during each few for from further had has have having her here hers him his how into its itself just "
    "may more most not now off once only other our ours out over own same she should some such than that the their them then there these they this those through too under until very was were what when where which while who "
    "whom why will with would you your".split()
)
#: A run of letters, digits, - and _; those that are words; most terms of a vocabulary.
RUN, WORD, VOCABULARY = "[\\p{L}\\p{N}_-]+", "^[a-z][a-z0-9-]{2,}$", 8000


def words(text: Column, stop: tuple[str, ...] = STOP) -> Column:
    """A text's words without stop words, in lower case, in order; null text: none. Each match is a whole run, empty
    where that is no word."""
    one = f"({WORD.strip('^$')}+)(?!{RUN.removesuffix('+')})|{RUN}"
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(one), F.lit(1))
    return F.filter(found, lambda w: ~w.isin("", *stop))


def grams(words: Column) -> Column:
    """The 1- and 2-grams of a text's words. They are named more than once here, so let them be a column."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def topic_terms(docs: DataFrame, topic: str, key: str = "doc_id", text: str = "text", vocabulary: int = VOCABULARY, most: int = 10, stop: tuple[str, ...] = STOP) -> DataFrame:
    """topic, size, label, terms: each topic's `most` terms of the largest mean weight (ties by the term), and its first
    three as a label. A text's weights are tf * (ln((1 + n) / (1 + df)) + 1), scaled to length 1; the mean is over all
    of a topic's texts. The vocabulary is the `vocabulary` terms of most occurrences (ties by the term).

    Texts are dealt by key as a row each, so a text's terms are counted where it lies and written as its list; their
    documents and weights are read from there. The vocabulary, of bounded size, is sent to all tasks. A topic without
    terms is labelled 'Topic' and its name. A null topic is one. Keys are distinct and not null."""
    texts = docs.select(F.col(key).alias("key"), F.col(topic).alias("topic"), words(F.col(text), stop).alias("words"))
    # outer, as for a plain explode the optimizer would filter by the list, and so make it once more
    counts = texts.select(F.explode_outer(grams(F.col("words"))).alias("term")).groupBy("term").agg(F.count("term").alias("total")).where("term IS NOT NULL")
    order = (F.desc("total"), "term")
    kept = cut(counts.orderBy(*order).limit(vocabulary).select((F.row_number().over(Window.orderBy(*order)) - 1).alias("id"), "term"))
    found = texts.repartition("key").select("key", "topic", F.explode_outer(grams(F.col("words"))).alias("term")).join(F.broadcast(kept), "term")
    tf = cut(found.groupBy("key", "topic", "id").agg(F.count("*").alias("tf")).groupBy("key", "topic").agg(F.collect_list(F.struct("id", "tf")).alias("ws")))
    df = tf.select(F.explode("ws.id").alias("id")).groupBy("id").agg(F.count("*").alias("df"))  # as many rows as the vocabulary
    n = docs.agg(F.count("*").alias("n"))
    factor = F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0
    factors = df.join(F.broadcast(n), F.lit(True)).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", factor.alias("f")))), lambda x: x["f"]).alias("factors"))
    weights = F.transform("ws", lambda x: F.struct(x["id"], (x["tf"] * F.get("factors", x["id"])).alias("w")))
    per_text = tf.join(F.broadcast(factors), F.lit(True)).select("topic", weights.alias("ws"))
    norm = F.sqrt(F.aggregate("ws", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    per_text = per_text.select("topic", "ws", norm.alias("norm"))  # once a text, before its list is spread
    scaled = per_text.select("topic", "norm", F.inline_outer("ws")).select("topic", "id", (F.col("w") / F.col("norm")).alias("w"))
    sizes = docs.groupBy(F.col(topic).alias("topic")).agg(F.count("*").alias("size"))
    sums = scaled.groupBy("topic", "id").agg(F.sum("w").alias("w")).join(F.broadcast(kept), "id")
    means = sums.join(F.broadcast(sizes), sums["topic"].eqNullSafe(sizes["topic"])).select(sums["topic"], "term", F.round(F.col("w") / F.col("size"), 9).alias("w"))
    best = means.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("w"), "term"))).where(F.col("rank") <= most)
    listed = best.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("found"))
    out = sizes.join(listed, sizes["topic"].eqNullSafe(listed["topic"]), "left").select(sizes["topic"], "size", "found")
    label = F.coalesce(F.array_join(F.slice("found", 1, 3), " / "), F.concat(F.lit("Topic "), F.coalesce(F.col("topic").cast("string"), F.lit(""))))
    return out.select(F.col("topic").alias(topic), "size", label.alias("label"), F.coalesce(F.array_join("found", ", "), F.lit("")).alias("terms"))
