"""Line dedup: an exact set-similarity join over lines, in DataFrame operations only.

A line is what lies between two newlines; its tokens are its distinct five-word shingles (words are
cut at white space and lower-cased; a line of fewer words is one token). Two lines match when the
Jaccard similarity of their token sets is 0.8 or more. A line goes if an earlier line, in the order
of doc_id and line number, matches it. Lines without words never match and stay.

Plan
1. A line's tokens are ordered by rarity: a token is as rare as its first word, whose count comes
   from a table of word counts by hash slot (SLOTS numbers, whatever the corpus holds); ties go by
   the token's hash. All but 80 % of the tokens, and one more, form the prefix. Place, line hash and
   prefix are written; the texts themselves are never shuffled.
2. Equal lines collapse to classes by the hash of their words, with the first place of each class;
   partial aggregation keeps a line that a third of all documents hold from meeting in one task. Of the
   lines only places and hashes are kept from here on.
3. Prefix tokens that lie in one class only go, and those of a class that shares them with none of a
   size within a quarter of its own. Classes with a shared one are read again at their
   first places, with all their tokens; a table of bits, some eight a class and at most MOST_BITS, sent
   to all tasks, leaves other lines behind in their own task (it never drops one). A
   sketch has a bit for the parity of the tokens in each of 256 parts, so that lines of hundreds of
   words are told apart, too.
4. In each token's group, in the order of places, a class meets the group's first member and the
   LAST members before it, under the length filter (neither set is a quarter larger than the other),
   the positional filter (the first shared token leaves room for the intersection) and a filter by
   sketch; then their tokens are compared. Of a family of near copies nearly all are settled here, without its pairs.
5. Only a class that is not settled meets all earlier members of its groups, under the same filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import release, stage

SHINGLE = 5
#: Hash slots of the table of word counts, whatever the size of the corpus.
SLOTS = 1 << 13
#: Least and greatest size of the table of classes that are read again, 1 MB and 16 MB.
LEAST_BITS, MOST_BITS = 1 << 23, 1 << 27
#: Words of 64 bits of a sketch, a power of two.
SKETCH = 4
#: Members before it that a class meets at first.
LAST = 3
SPACE = "[ \\t\\n\\x0B\\f\\r]"
LOW56 = (1 << 56) - 1


def lines_of(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, line_no (from 0), line: a row for each line with words, in lower case and set apart by one space."""
    split = docs.select(F.col(key).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))
    odd = F.contains(F.col("line"), F.lit("  "))
    for c in "\t\x0b\f\r":
        odd = odd | F.contains(F.col("line"), F.lit(c))
    plain = F.when(odd, F.regexp_replace("line", f"{SPACE}+", " ")).otherwise(F.col("line"))
    return split.select("doc_id", "line_no", F.lower(F.trim(plain)).alias("line")).where("line <> ''")


def _hashed(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, words (hashes), h: the hash of them all."""
    words = lines.select("doc_id", "line_no", F.transform(F.split("line", " "), lambda w: F.xxhash64(w)).alias("words"))
    return words.withColumn("h", F.xxhash64("words"))


def word_classes(docs: DataFrame, text: str = "text") -> list[int]:
    """Rarity classes of words by hash slot: the logarithm of the count of all words in the slot."""
    words = docs.select(F.explode(F.split(F.lower(F.replace(F.col(text), F.lit("\n"), F.lit(" "))), " ")).alias("w"))
    found = dict(words.groupBy(F.pmod(F.xxhash64("w"), F.lit(SLOTS)).cast("int").alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect())
    return [found.get(k, 0).bit_length() for k in range(SLOTS)]


def _tokens(w: Column, token) -> Column:
    """Distinct tokens of a line's words w, sorted: token(five words) for each five of them, or token(all) of a shorter line."""
    n = F.size(w)
    of = lambda i: token([F.get(w, i + k) for k in range(SHINGLE)])
    return F.sort_array(F.array_distinct(F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(0), n - SHINGLE), of)).otherwise(F.array(token([w])))))


def _prefixes(hashed: DataFrame, rarity: list[int]) -> DataFrame:
    """doc_id, line_no, h, n (tokens), prefix: the rarest tokens, each a rarity class over 56 bits of a hash."""
    classes = F.split(F.lit(",".join(map(str, rarity))), ",").cast("array<long>")  # folded to a constant
    ranked = lambda x: F.shiftleft(F.get(classes, F.pmod(x, F.lit(SLOTS)).cast("int")), 56).bitwiseOR(x.bitwiseAND(F.lit(LOW56)))

    def token(words: list[Column]) -> Column:
        first = words[0] if len(words) > 1 else F.get(words[0], F.lit(0))  # its class is on top
        return first.bitwiseAND(F.lit(~LOW56)).bitwiseOR(F.xxhash64(*words).bitwiseAND(F.lit(LOW56)))

    packed = hashed.select("doc_id", "line_no", "h", F.transform("words", ranked).alias("w"))
    toks = packed.select("doc_id", "line_no", "h", _tokens(F.col("w"), token).alias("toks"))
    n = F.size("toks")
    return toks.select("doc_id", "line_no", "h", n.alias("n"), F.slice("toks", F.lit(1), n - F.ceil(n * 4 / 5).cast("int") + 1).alias("prefix"))


#: The order of lines.
PLACE = "struct(isnull(doc_id) AS none, doc_id, line_no)"


def _classes(lines: DataFrame) -> DataFrame:
    """Distinct lines: h, first place (struct), copies, n, prefix."""
    return lines.groupBy("h").agg(F.min(F.expr(PLACE)).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))


def _met(classes: DataFrame) -> DataFrame:
    """t, h, n, pos: postings of prefix tokens that lie in another class of a size that may match, too; of all sizes in a
    token's group, those next to a class's own are the nearest."""
    posted = classes.select("h", "n", F.posexplode("prefix").alias("pos", "t"))
    posted = posted.select("t", "h", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos")).alias("v"))
    by_size = Window.partitionBy("t").orderBy("v")
    met = posted.select("t", "h", "v", *(F.shiftright(c, 32).alias(k) for k, c in (("n", F.col("v")), ("under", F.lag("v").over(by_size)), ("over", F.lead("v").over(by_size)))))
    met = met.where("5 * under >= 4 * n or 5 * n >= 4 * over")
    return stage(met.select("t", "h", F.shiftright("v", 32).cast("int").alias("n"), F.col("v").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("pos")), "met")


def _sketch(toks: Column) -> Column:
    """A bit for the parity of the tokens in each part, as a struct of SKETCH numbers."""
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int"))
    word = lambda t: F.shiftright(t, 6).bitwiseAND(F.lit(SKETCH - 1))
    parity = lambda k: F.aggregate(toks, F.lit(0).cast("long"), lambda acc, t: F.when(word(t) == k, acc.bitwiseXOR(bit(t))).otherwise(acc))
    return F.struct(*(parity(k).alias(f"s{k}") for k in range(SKETCH)))


def _table(places: DataFrame, bits: int) -> DataFrame:
    """bucket, map: the bits of the places (at), in rows of 4 kB. Places are dealt by bucket first, so that no map is
    shuffled."""
    slot = F.pmod("at", F.lit(bits)) + 1
    dealt = places.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit")).repartition("bucket")
    return dealt.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map"))


def _read_again(docs: DataFrame, classes: DataFrame, met: DataFrame, text: str, key: str) -> DataFrame:
    """h, first, toks, sketch of the classes in met: read at the first place of each."""
    wanted = stage(classes.select("h", "first").join(met.select("h").distinct(), "h"), "wanted")
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * wanted.count()).bit_length()))
    at = lambda doc, line: F.xxhash64(F.coalesce(doc, F.lit(-1)), line)
    table = _table(wanted.select(at(F.col("first.doc_id"), F.col("first.line_no")).alias("at")), bits)
    slot = F.pmod(at(F.col("doc_id"), F.col("line_no")), F.lit(bits)) + 1
    own = lines_of(docs, text, key).withColumn("bucket", F.bitmap_bucket_number(slot)).withColumn("bit", F.bitmap_bit_position(slot))
    byte = F.conv(F.hex(F.substring("map", F.shiftright("bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = _hashed(own.join(F.broadcast(table), "bucket").where(F.getbit(byte, F.col("bit").bitwiseAND(F.lit(7)).cast("int")) == 1))
    toks = near.select("h", _tokens(F.col("words"), lambda words: F.xxhash64(*words)).alias("toks"))
    again = wanted.join(toks.groupBy("h").agg(F.first("toks").alias("toks")), "h").withColumn("sketch", _sketch(F.col("toks")))
    out = stage(again, "toks")
    release(wanted)
    return out


def _later(pairs: DataFrame, toks: DataFrame) -> DataFrame:
    """h of the later ones among pairs (ha before hb) that match."""
    side = lambda s: toks.select(F.col("h").alias("h" + s), F.col("toks").alias("t" + s))
    both = pairs.distinct().join(side("a"), "ha").join(side("b"), "hb")
    sizes = both.select("hb", F.size(F.array_intersect("ta", "tb")).alias("common"), (F.size("ta") + F.size("tb")).alias("all"))
    return sizes.where("100 * common >= 80 * (all - common)").select(F.col("hb").alias("h")).distinct()


#: Postings a and b of one token that may be of matching classes: length filter, positional filter, and of the
#: parities of their tokens no more may differ than tokens do in sets that match.
FILTERS = """a.h <> b.h and 5 * a.n >= 4 * b.n and 5 * b.n >= 4 * a.n and least(a.n - a.pos, b.n - b.pos) >= ceil((a.n + b.n) * 4 / 9)
 and """ + " + ".join(f"bit_count(a.sketch.s{k} ^ b.sketch.s{k})" for k in range(SKETCH)) + " <= a.n + b.n - 2 * ceil((a.n + b.n) * 4 / 9)"


def matching_lines(docs: DataFrame, classes: DataFrame, met: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """h of every class of equal lines that matches an earlier, different class; classes: h and first of those of _classes;
    met: their postings, which are deleted."""
    toks = _read_again(docs, classes, met, text, key)
    shared = stage(met.join(toks.select("h", "first", "sketch"), "h"), "shared")
    release(met)
    order = Window.partitionBy("t").orderBy("first", "h")
    own = F.struct("h", "n", "pos", "sketch")
    near = shared.select(own.alias("b"), F.array(F.first(own).over(order), *(F.lag(own, k).over(order) for k in range(1, LAST + 1))).alias("a"))
    near = near.select("b", F.explode("a").alias("a")).where(FILTERS).select(F.col("a.h").alias("ha"), F.col("b.h").alias("hb"))
    settled = stage(_later(near, toks), "settled")
    rest = shared.join(settled, "h", "left_anti")
    pairs = shared.alias("a").join(rest.alias("b"), F.col("a.t") == F.col("b.t")).where("a.first < b.first and " + FILTERS)
    found = stage(_later(pairs.select(F.col("a.h").alias("ha"), F.col("b.h").alias("hb")), toks), "found")
    out = stage(settled.unionByName(found), "near")
    release(shared, toks, settled, found)
    return out


def repeated_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, line_no of the lines that go.

    Null texts have no line; lines without words stay; rows that repeat as a whole count as one
    document (a line number's first row stays in each); a null doc_id comes after all others.
    """
    lines = stage(_prefixes(_hashed(lines_of(docs, text, key)), word_classes(docs, text)), "lines")
    classes = stage(_classes(lines), "classes")
    places = stage(lines.select("doc_id", "line_no", "h"), "places")
    release(lines)
    met = _met(classes)
    heads = stage(classes.select("h", "first", "copies"), "heads")
    release(classes)
    near = matching_lines(docs, heads, met, text, key)
    judged = heads.join(near.withColumn("near", F.lit(True)), "h", "left").where("copies > 1 or near")
    gone = places.join(judged, "h").where(F.col("near").isNotNull() | ~(F.expr(PLACE).eqNullSafe(F.col("first"))))
    out = stage(gone.select("doc_id", "line_no"), "gone")
    release(heads, places, near)
    return out


def line_decisions(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers, ascending) of every document."""
    gone = repeated_lines(docs).groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))
    own = docs.select("doc_id", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).alias("n_lines"))
    own = own.withColumn("n_lines", F.greatest("n_lines", F.lit(0)).cast("long"))
    full = own.join(gone, own["doc_id"].eqNullSafe(gone["doc_id"]), "left").drop(gone["doc_id"])
    empty = F.array().cast("array<int>")
    return full.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", empty).alias("removed")).withColumn("n_removed", F.greatest("n_removed", F.lit(0)))


def without_repeated_lines(docs: DataFrame, keep_emptied: bool = True) -> DataFrame:
    """docs with the lines that go taken out of text; all columns kept; n_chars, if there, follows.

    keep_emptied=False leaves out documents that lose all their words: every line of theirs stands
    in an earlier document. Documents that never had words stay."""
    gone = repeated_lines(docs).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("line_no").alias("_gone"))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains("_gone", i)), "\n")
    full = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    full = full.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept))
    if not keep_emptied:
        full = full.where(F.col("_gone").isNull() | F.col("text").rlike(SPACE.replace("[", "[^", 1)))
    if "n_chars" in docs.columns:
        full = full.withColumn("n_chars", F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return full.select(*docs.columns)
