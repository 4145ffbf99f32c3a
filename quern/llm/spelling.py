"""Spelling variants: words one edit apart, found through Aho-Corasick automata of word halves.

One edit leaves one of a word's two halves as it is: the first half stands at the start of the other word, or the second
half at its end. Automaton shards hold the halves of every word; every word is scanned by each shard that can hold a half
of a near word. Where a half is met, its offset and both lengths must fit, and then the distance of the rest is verified.

A half's shard is a hash of the half, so shards are even, and a word goes to at most four of them: its starts and
ends of the lengths that halves of words with one code point less, as many or one more can have. Words that share a half
are looked up by the rest with one code point deleted, not pair by pair. A half of more than `split` words is dealt
over several tasks by those rests.

Words are counted over all texts, a null text has none, and a null doc_id has no digits before the colon. Rows that
repeat count each time.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import LOWER, bounded, lean, release, stage, texts, width

#: Fewest code points and occurrences of a word; times that a form has to be the more frequent one.
LENGTH, TIMES, MORE = 7, 2, 10
#: Words of one half from which it is dealt over several tasks, and halves in one automaton.
SPLIT, HELD = 20_000, 100_000
_RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")  # [A-Za-zÀ-ÿ] in UTF-8
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            if text is None:
                continue
            head = zlib.crc32(b"" if doc is None else b"%d" % doc)
            head = zlib.crc32(b":", head)
            for word, n in Counter(_RUN.findall(text.translate(LOWER))).items():
                if len(word) < LENGTH:
                    continue
                h = zlib.crc32(word, head)
                if h % 31 == 0:
                    chars = word.decode()
                    at = h % len(chars)
                    word = (chars[:at] + chars[at + 1 :]).encode()
                if len(word) - word.count(0xC3) >= LENGTH:
                    found[word] += n
            if len(found) >= COUNTED:
                yield rows()
                found.clear()
    yield rows()


def vocabulary(documents: DataFrame) -> DataFrame:
    """(word, n) of every word that is long and frequent enough."""
    rows = bounded(documents.select("doc_id", "text")).mapInArrow(lean(_counts), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TIMES)


def halves(word: str) -> list[tuple[int, str]]:
    """(side, half): 0 for the first, 1 for the second."""
    return [(0, word[: len(word) // 2]), (1, word[len(word) // 2 :])]


def probes(word: str) -> set[tuple[int, str]]:
    """What halves of near words can be met at the start and at the end of word."""
    n = range(len(word) - 1, len(word) + 2)
    return {(0, word[: m // 2]) for m in n} | {(1, word[-(m - m // 2) :]) for m in n}


def deletions(rest: str) -> set[str]:
    """rest, and rest without one code point: two rests at most one edit apart have one of these in common."""
    return {rest, *(rest[:i] + rest[i + 1 :] for i in range(len(rest)))}


def near(a: str, b: str) -> bool:
    """Whether a and b differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _dealt_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each half that a word holds, and one for each shard that has to scan it."""
    for batch in batches:
        out: list[tuple] = []
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out += ((zlib.crc32(half.encode(), side), True, side, half, word, n) for side, half in halves(word))
            out += ((zlib.crc32(half.encode(), side), False, side, half, word, n) for side, half in probes(word))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _SHARD, strict=True)], schema=_SHARD)


_SHARD = pa.schema([("h", pa.int64()), ("held", pa.bool_()), ("side", pa.int8()), ("half", pa.string()), ("word", pa.string()), ("n", pa.int64())])
_NEAR = "word string, other string, n long"


class Shard:
    """An automaton of halves, with the words of each."""

    FEW = 16

    def __init__(self, held: list[tuple[int, str, str, int]]):
        self.found: dict[tuple[int, str], list[tuple[str, int]]] = defaultdict(list)
        for side, half, word, n in held:
            self.found[side, half].append((word, n))
        self.rests: dict[tuple[int, str], dict[str, list[tuple[str, int]]]] = {}
        for (side, half), words in self.found.items():
            if len(words) > self.FEW:
                by = self.rests[side, half] = defaultdict(list)
                for word, n in words:
                    for key in deletions(_rest(word, side, half)):
                        by[key].append((word, n))
        self.automaton = ahocorasick.Automaton()
        for half in {half for _, half in self.found}:
            self.automaton.add_word(half, half)
        if len(self.automaton):
            self.automaton.make_automaton()

    def scan(self, word: str) -> Iterator[tuple[str, int]]:
        """The near words of word whose half is met at the right place. Met by both halves, a word counts by its first."""
        if not len(self.automaton):
            return
        for end, half in self.automaton.iter(word):
            for side in (0, 1):
                if (side, half) not in self.found or end != (len(half) - 1 if side == 0 else len(word) - 1):
                    continue
                by = self.rests.get((side, half))
                some = self.found[side, half] if by is None else {x for key in deletions(_rest(word, side, half)) for x in by.get(key, ())}
                for other, n in some:
                    if abs(len(other) - len(word)) <= 1 and near(word, other) and not (side == 1 and word.startswith(other[: len(other) // 2])):
                        yield other, n


def _rest(word: str, side: int, half: str) -> str:
    return word[len(half) :] if side == 0 else word[: len(word) - len(half)]


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shard by shard: the held halves come first, then the words to scan."""
    held: list[tuple] = []
    shard, now, done = None, None, ""
    for batch in batches:
        out: list[tuple] = []
        for key, is_held, side, half, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != now:
                now, held, shard, done = key, [], None, ""
            if is_held:
                held.append((side, half, word, n))
                continue
            if shard is None:
                shard = Shard(held)
            if word != done:  # a word comes once for each of its probes in this shard
                done = word
                out += ((word, other, m) for other, m in shard.scan(word))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["word", "other", "n"])


def near_words(words: DataFrame, split: int = SPLIT) -> DataFrame:
    """(word, other, n): each word of words (word, n) with each word that is near it, and that one's n."""
    spark = words.sparkSession
    dealt = stage(words.select("word", "n").mapInArrow(lean(_dealt_words), "h long, held boolean, side tinyint, half string, word string, n long"), "halves", "zstd")
    hot = dealt.where("held").groupBy("side", "half").agg(F.count("*").alias("words")).where(F.col("words") > split).select("side", "half")
    plain, more = dealt, None
    if hot.limit(1).count():
        plain = dealt.join(hot, ["side", "half"], "left_anti")
        more = _by_rest(dealt.join(hot, ["side", "half"]))
    n = width(spark)
    shards = max(4 * n, math.ceil(plain.where("held").count() / HELD))
    plain = plain.select(F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int").alias("shard"), "held", "side", "half", "word", "n")
    plain = plain.repartitionById(n, F.pmod("shard", F.lit(n))).sortWithinPartitions("shard", F.desc("held"), "word")
    found = plain.mapInArrow(lean(_scanned), _NEAR)
    return found if more is None else found.unionByName(more)


def _by_rest(dealt: DataFrame) -> DataFrame:
    """As a shard does, for halves of many words: a join on the rest with one code point deleted, then the same checks."""
    rest = F.when(F.col("side") == 0, F.expr("substr(word, length(half) + 1)")).otherwise(F.expr("left(word, length(word) - length(half))"))
    keys = F.expr("explode(array_distinct(concat(array(rest), transform(sequence(1, greatest(length(rest), 1)), i -> concat(left(rest, i - 1), substr(rest, i + 1))))))")
    cut = dealt.withColumn("rest", rest).select("held", "side", "half", "word", "n", keys.alias("key"))
    held = cut.where("held").select("side", "half", "key", F.col("word").alias("other"), "n")
    pairs = cut.where("NOT held").select("side", "half", "key", "word").join(held, ["side", "half", "key"])
    first = F.expr("startswith(word, left(other, length(other) div 2))")
    fits = (F.abs(F.length("word") - F.length("other")) <= 1) & (F.levenshtein("word", "other") == 1) & ~((F.col("side") == 1) & first)
    return pairs.where(fits).select("word", "other", "n").distinct()


def variants(documents: DataFrame, split: int = SPLIT) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = stage(vocabulary(documents), "words")
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("other").alias("form")))
    met = near_words(words, split).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(met, "word", "left")
    n = -F.col("best.less")
    is_form = n >= MORE * F.col("n")
    forms = stage(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, n).alias("form_n")), "forms")
    roots = stage(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    most = words.agg(F.max("n")).first()[0] or 0
    # each form is at least MORE times as frequent, so no way is longer than this; each round doubles what a word has gone
    steps = max(1, math.ceil(math.log(max(most, 2) / TIMES, MORE)) + 1)
    for _ in range(math.ceil(math.log2(steps))):
        nxt = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stage(roots.join(nxt, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        release(roots)
        roots = step
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
