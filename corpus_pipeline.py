"""The corpus pipeline: five filters and transformations of `documents`, each a written table.

STAGES gives the order; every stage takes what its predecessor kept, and its decisions take effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from quern.llm.common import release, stage


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts have the score of no word; repeated rows share
    one fate; without labels nothing goes."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies and near copies of a line go, and with its last line a document that is a copy throughout. Null
    texts and texts without words stay; rows that repeat as a whole are one document; null ids come last."""
    return line_dedup.without_repeated_lines(docs, keep_emptied=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest doc_id. Texts without words, and null ids, stay;
    rows of one doc_id stay or go together."""
    return ngram_join.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go, each judged by its own text. Null and empty texts stay; an empty
    benchmark takes nothing."""
    return decontaminate.clean_of(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths. A null or empty text is the end id alone; rows that repeat are
    documents of their own."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("ngram_jaccard_join", near_duplicates), ("decontamination", benchmark), ("packing", pack)]

#: Learned weights and a subword vocabulary cannot be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name, "zstd")
        if before is not None:
            release(before)  # the next stage's table holds what it kept
        before = docs
    return docs
