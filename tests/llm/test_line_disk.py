"""What the join of lines leaves on disk, and how many pairs of long lines it compares."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quern.llm import common, line_dedup


def shuffle_files(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(".data" in files.apply(i).getName() for i in range(files.size()))


def test_stages_give_their_shuffles_back(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = shuffle_files(spark), spark.conf.get(name, None)
    out = common.stage(spark.range(1000).groupBy(F.col("id") % 7).count(), "test")
    for _ in range(50):  # files go in the background
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.2)
    assert shuffle_files(spark) <= before
    assert out.count() == 7 and spark.conf.get(name, None) == was


def test_long_lines_that_share_a_phrase_are_not_compared(spark, monkeypatch):
    rng = random.Random(5)
    phrase = " ".join(f"rare{k}" for k in range(12))
    text = lambda: " ".join(rng.choice(["a", "b", "c", "d", "e", "f", "g", "h"]) for _ in range(200))
    lines = [f"{text()} {phrase} {text()}" for _ in range(40)]
    rows = [(k, line) for k, line in enumerate(lines)] + [(100, lines[7] + " z")]
    pairs = []

    def later(some, toks):
        pairs.append(some.distinct().count())
        return real(some, toks)

    real = line_dedup._later
    monkeypatch.setattr(line_dedup, "_later", later)
    gone = line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["line_no"]) for r in gone] == [(100, 0)]
    assert sum(pairs) < 10  # 780 pairs share the phrase; parities in 64 parts kept most of them


@pytest.mark.parametrize("bits", [64, 1 << 16])
def test_a_full_table_of_classes_loses_none(spark, monkeypatch, bits):
    monkeypatch.setattr(line_dedup, "LEAST_BITS", bits)
    monkeypatch.setattr(line_dedup, "MOST_BITS", bits)
    line = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(k, line(k)) for k in range(100)] + [(1000 + k, line(k) + " z") for k in range(0, 100, 2)]
    gone = line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in gone) == [1000 + k for k in range(0, 100, 2)]
