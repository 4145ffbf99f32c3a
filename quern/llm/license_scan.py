"""Licence phrases and texts in documents by diagonal voting.

Every text gives its rolling word k-grams as hashes, which are joined to the positions of the same k-grams in the
templates. A hit is a vote, once its words are compared, for the diagonal (document position less template position) on
which the template would lie. Votes are counted by diagonal. A phrase stands where a diagonal has all its k-grams. A
longer template may be cut or edited, so diagonals a few words apart are merged to one span, and a span counts if it
covers enough of the template's words within a bounded stretch of the document.

Templates are a parameter. Their table is broadcast as long as it is small (`FEW` k-grams), else joined by shuffle.
A null text has no words; a template of one word is no phrase that a 2-gram can find, and is refused. Rows are told
apart by their place, so rows of one doc_id, or of none, each have their own result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import ALNUM, bounded, lean, mix, windows

#: k of phrases and of texts; diagonals so far apart are merged; share of a text's words that a span has to cover.
PHRASE_K, TEXT_K, APART, SHARE = 2, 3, 3, 0.8  # PHRASE_K + 1 is TEXT_K
#: k-grams of templates up to which their table is broadcast.
FEW = 100_000


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False


# The three base phrases with their labels.
PHRASES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
)
# Notices as their publishers print them.
TEXTS = (
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    Template(
        "apache-notice",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    Template(
        "mit-text",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    Template(
        "bsd-text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution.",
    ),
    Template(
        "isc-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    Template(
        "gpl-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    Template("mpl-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
TEMPLATES = PHRASES + TEXTS

#: Stands before each document's k-grams and finds the row of no template, so that every document has a row.
SELF = 0x5E1F
_MARKS = np.frombuffer(ALNUM, np.uint8)


def _words(column: pa.Array) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """(all words, words of each text, hashes of words) of a column of texts."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = _MARKS[np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]]] if raw is not None and raw.size else np.empty(0, np.uint8)
    ends = ends - ends[0]
    inside = data != 32
    cut = np.zeros(len(data) + 1, bool)  # where another text begins
    cut[ends] = True
    first = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | cut[:-1]))
    last = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | cut[1:])) + 1
    sizes = last - first
    kept = data[inside]
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(at), pa.py_buffer(kept))
    counts = np.bincount(np.searchsorted(ends, first, "right") - 1, minlength=len(column)) if len(first) else np.zeros(len(column), np.int64)
    if not len(first):
        return words, counts, np.empty(0, np.uint64)
    powers = np.cumprod(np.full(int(sizes.max()), 0x100000001B3, np.uint64))
    place = np.arange(len(kept)) - np.repeat(at[:-1], sizes)
    hashes = np.add.reduceat((kept.astype(np.uint64) + np.uint64(1)) * powers[place], at[:-1])
    return words, counts, mix(hashes + sizes.astype(np.uint64))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text's words, and SELF with its hashes of k-grams: 2 * p + 1 and 2 * p + 2 are those that start at word p."""
    for batch in batches:
        words, counts, hashes = _words(batch.column(2))
        ends = np.concatenate([[0], np.cumsum(counts)])
        left = np.repeat(ends[1:], counts) - np.arange(len(words))  # words to a text's end
        grams = np.zeros(2 * len(words) + len(counts), np.uint64)
        heads = 2 * ends[:-1] + np.arange(len(counts))
        at = 2 * np.arange(len(words)) + np.repeat(np.arange(len(counts)), counts) + 1
        for i, k in enumerate((PHRASE_K, TEXT_K)):
            of = windows(hashes, k)
            ok = np.flatnonzero(left >= k)
            grams[at[ok] + i] = of[ok]
        grams[heads] = SELF
        lists = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), v) for o, v in ((ends, words), (np.concatenate([heads, [len(grams)]]), pa.array(grams.view(np.int64))))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts.astype(np.int64)), *lists], ["row", "doc_id", "n_words", "words", "grams"])


def template_positions(spark: SparkSession, templates: tuple[Template, ...]) -> tuple[DataFrame, int]:
    """(label, phrase, size, k, at, gram, h) of every k-gram of every template, and how many there are."""
    rows = [(None, False, 0, 0, 0, "", SELF)]
    for t in templates:
        words, _, hashes = _words(pa.array([t.text]))
        words, k = words.to_pylist(), PHRASE_K if t.phrase else TEXT_K
        if len(words) < k:
            raise ValueError(f"{t.label}: fewer than {k} words")
        rows += ((t.label, t.phrase, len(words), k, i, " ".join(words[i : i + k]), int(np.int64(h))) for i, h in enumerate(windows(hashes, k).view(np.int64)))
    return spark.createDataFrame(rows, "label string, phrase boolean, size int, k int, at int, gram string, h long"), len(rows)


def votes(documents: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(row, doc_id, n_words, label, phrase, size, k, diagonal, ats, first, last), and a row of no label for each document."""
    held, n = template_positions(documents.sparkSession, templates)
    texts = bounded(documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    grams = texts.mapInArrow(lean(_grams), f"row long, doc_id {dict(documents.dtypes)['doc_id']}, n_words long, words array<string>, grams array<long>")
    hits = grams.select("row", "doc_id", "n_words", "words", F.posexplode("grams").alias("place", "h"))
    hits = hits.withColumn("word", F.expr("(place - 1) div 2")).withColumn("order", F.when(F.col("place") > 0, (F.col("place") - 1) % 2 + PHRASE_K).otherwise(0))
    said = F.expr("array_join(slice(words, int(word) + 1, order), ' ')")
    if n <= FEW:
        hits = hits.join(F.broadcast(held), "h").where((F.col("order") == F.col("k")) & (said == F.col("gram")))
    else:  # a k-gram is shuffled with its own words, not with its document's
        hits = hits.select("row", "doc_id", "n_words", "h", "word", F.col("order").alias("k"), said.alias("gram")).join(held, ["h", "k", "gram"])
    by = ["row", "doc_id", "n_words", "label", "phrase", "size", "k", (F.col("word") - F.col("at")).alias("diagonal")]
    return hits.groupBy(*by).agg(F.collect_set("at").alias("ats"), F.min("word").alias("first"), F.max(F.col("word") + F.col("k")).alias("last"))


def spans(found: DataFrame, share: float = SHARE) -> DataFrame:
    """(row, doc_id, n_words, label, phrase, first, last, share): verified spans, and a row of no label for each document.
    first is the span's first word, last the one after it; share is what it has of the template's words."""
    near = Window.partitionBy("row", "label").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(near) > F.when(F.col("phrase"), 0).otherwise(APART)
    found = found.withColumn("span", F.sum(F.when(apart, 1).otherwise(0)).over(near.rowsBetween(Window.unboundedPreceding, 0)))
    merged = found.groupBy("row", "doc_id", "n_words", "label", "phrase", "size", "k", "span").agg(F.flatten(F.collect_set("ats")).alias("ats"), F.min("first").alias("first"), F.max("last").alias("last"))
    covered = F.expr("size(array_distinct(flatten(transform(ats, a -> sequence(a, a + greatest(k, 1) - 1)))))")
    merged = merged.withColumn("share", F.when(F.col("label").isNotNull(), covered / F.col("size")))
    whole = F.when(F.col("phrase"), F.col("share") == 1).otherwise((F.col("share") >= share) & (F.col("last") - F.col("first") <= 1.25 * F.col("size") + 2))
    return merged.where(F.col("label").isNull() | whole).select("row", "doc_id", "n_words", "label", "phrase", "first", "last", "share")


def scanned(documents: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each document. score is the
    greatest share of a template that a verified span has; a phrase is there as a whole, so it counts 1."""
    base = F.when(F.col("phrase") & F.col("label").isNotNull(), F.col("first"))
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans(votes(documents, templates)).groupBy("row", "doc_id", "n_words").agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"), names(F.when(base.isNotNull(), F.col("label"))).alias("base_labels"), names("label").alias("labels"), F.coalesce(F.max("share"), F.lit(0.0)).alias("score")
    )
    return found.drop("row")
