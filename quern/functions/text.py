"""Scalar functions over text. White space is the ASCII set unless said otherwise; no match is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "[ \\t\\n\\r\\f\\x0B]"
SENTENCE_END = f"(?<=[.!?])(?={SPACE})"


def nullif_empty(c: Column) -> Column:
    return F.when(c != "", c)


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null if there is none or it is empty."""
    return nullif_empty(F.regexp_extract(c, pattern, group))


def clean_text(c: Column, keep_newlines: bool = False) -> Column:
    """Newlines to \\n, control characters out, white space collapsed, ends trimmed."""
    c = F.regexp_replace(c, "\\r\\n?", "\n")
    c = F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    if not keep_newlines:
        return F.trim(F.regexp_replace(c, "[ \\t\\n\\u00A0]+", " "))
    c = F.regexp_replace(c, "[ \\t\\u00A0]+", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, " +\\n", "\n"), "\\n{3,}", "\n\n"), "^[ \\n]+|[ \\n]+$", "")


#: Factors of amount suffixes. Fixed values.
SUFFIXES = {"b": 1e9, "billion": 1e9, "m": 1e6, "million": 1e6, "k": 1e3, "thousand": 1e3}


def parse_usd(c: Column) -> Column:
    """An amount such as $1,234.56, 57.8M, $5.2 billion or a plain number; null if it is none."""
    text = F.trim(F.regexp_replace(F.translate(F.trim(c), ",$", ""), "\\.+$", ""))
    whole = "(?i)^\\s*([0-9]+(?:\\.[0-9]+)?)\\s*(million|billion|thousand|[bmk])?\\s*$"
    number = extract(text, whole).try_cast("double")
    suffix = F.lower(F.regexp_extract(text, whole, 2))
    factor = F.lit(1.0)
    for name, value in SUFFIXES.items():
        factor = F.when(suffix == name, value).otherwise(factor)
    return number * factor


def loose_usd(c: Column) -> Column:
    """The first number of a text such as "about $57.8M", by a billion or a million where the text names one or ends in
    a capital B or M; null without a number, and where the first run of digits and points is none."""
    text = F.translate(c, ",$", "")
    low = F.lower(text)
    factor = F.when(F.contains(low, F.lit("billion")) | F.endswith(text, F.lit("B")), 1e9).when(F.contains(low, F.lit("million")) | F.endswith(text, F.lit("M")), 1e6).otherwise(1.0)
    return extract(text, "([0-9.]+)").try_cast("double") * factor


def format_quarter(year: Column, quarter: Column, missing: str | None = "Unknown") -> Column:
    """'Q# YYYY'; a missing or zero part gives `missing`."""
    known = (F.coalesce(year, F.lit(0)) != 0) & (F.coalesce(quarter, F.lit(0)) != 0)
    return F.when(known, F.concat(F.lit("Q"), quarter.cast("string"), F.lit(" "), year.cast("string"))).otherwise(F.lit(missing))


def file_facts(name: Column) -> Column:
    """disaster_code, year, quarter of a file name: the first of three spellings of the quarter counts;
    what stands before it, without separators and a leading 'drgr-', is the code."""
    n = F.regexp_replace(F.lower(name), "\\.pdf$", "")
    spellings = (("([0-9]{4})-q([1-4])", 1, 2), ("([0-9]{4})-([1-4])q", 1, 2), ("q([1-4])-([0-9]{4})", 2, 1))
    year = quarter = before = F.lit(None).cast("string")
    for pattern, y, q in reversed(spellings):
        hit = n.rlike(pattern)
        year = F.when(hit, F.regexp_extract(n, pattern, y)).otherwise(year)
        quarter = F.when(hit, F.regexp_extract(n, pattern, q)).otherwise(quarter)
        before = F.when(hit, F.regexp_extract(n, f"^(.*?){pattern}", 1)).otherwise(before)
    code = F.regexp_replace(F.regexp_replace(F.coalesce(before, n), "^[-_ .]+|[-_ .]+$", ""), "^drgr-", "")
    return F.struct(F.coalesce(nullif_empty(code), F.lit("unknown")).alias("disaster_code"), year.try_cast("int").alias("year"), quarter.try_cast("int").alias("quarter"))


def category_of_path(path: Column) -> Column:
    """Name of the folder that holds a file."""
    return F.element_at(F.split(path, "/"), -2)


def format_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB with one decimal."""
    out = F.format_string("%.1f TB", n / F.lit(1024.0**4))
    for unit, power in (("GB", 3), ("MB", 2), ("KB", 1)):
        out = F.when(n < 1024.0 ** (power + 1), F.format_string(f"%.1f {unit}", n / F.lit(1024.0**power))).otherwise(out)
    return F.when(n < 1024, F.format_string("%.1f B", n.cast("double"))).otherwise(out)


def normalize_key(c: Column) -> Column:
    """A name's matching key: & is 'and', letters and digits in lower case, single spaces, no leading 'the'."""
    key = F.regexp_replace(F.lower(F.regexp_replace(c, "&", " and ")), "[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(F.trim(key), "^the ", ""))


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def chunk_words(c: Column, size: int, overlap: int) -> Column:
    """Windows of `size` words that share `overlap` with the one before; the last one reaches the end."""
    step = max(1, size - overlap)
    w = words(c)
    n = F.size(w)
    count = F.when(n <= size, F.least(n, F.lit(1))).otherwise(F.ceil((n - size) / step) + 1).cast("int")
    starts = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: k * step)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, F.lit(size)), " "))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


#: Elements that `running` adds up before it starts a new block.
BLOCK = 256


def running(lengths: Column) -> Column:
    """Running sums of an array of ints, in blocks, so that time grows with the length and not its square."""
    add = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))
    empty = F.array().cast("array<int>")
    blocks = lambda n: F.transform(F.sequence(F.lit(0), F.size(n) - 1, F.lit(BLOCK)), lambda at: F.aggregate(F.slice(n, at + 1, F.lit(BLOCK)), empty, add))
    before = lambda own: F.aggregate(F.transform(own, lambda x: F.element_at(x, -1)), F.array(F.lit(0)), add)
    summed = lambda own: let(before(own), lambda to: F.flatten(F.transform(own, lambda x, i: F.transform(x, lambda v: v + F.get(to, i)))))
    return F.when(F.size(lengths) > 0, let(lengths, lambda n: let(blocks(n), summed))).otherwise(empty)


def spans(c: Column, pattern: str) -> Column:
    """All matches with code-point offsets: structs of start, end and text. The pattern has no groups.

    Matches and what lies between them alternate, so running lengths are the offsets."""
    both = F.struct(F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1)).alias("found"), F.split(c, pattern, -1).alias("between"))
    ends = lambda x: running(F.transform(x["found"], lambda m, i: F.length(m) + F.length(F.get(x["between"], i))))
    return let(both, lambda x: F.transform(F.arrays_zip(x["found"].alias("m"), ends(x).alias("e")), lambda z: F.struct((z["e"] - F.length(z["m"])).alias("start"), z["e"].alias("end"), z["m"].alias("text"))))


def without_overlaps(found: Column) -> Column:
    """Spans (priority, start, end, ...) with the most important kept first, and none that overlaps a kept one."""
    empty = F.slice(found, 1, 0)
    clear = lambda kept, x: ~F.exists(kept, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"]))
    return F.aggregate(F.array_sort(found), empty, lambda kept, x: F.when(clear(kept, x), F.concat(kept, F.array(x))).otherwise(kept))


def sentences(c: Column) -> Column:
    """Sentences with offsets: a text is cut behind . ! or ? where white space follows."""
    trimmed = lambda x: F.regexp_replace(x, f"^{SPACE}+", "")
    of = lambda z: let(trimmed(z["p"]), lambda t: F.struct((z["e"] - F.length(t)).alias("start"), z["e"].alias("end"), t.alias("text")))
    cut = let(F.split(c, SENTENCE_END, -1), lambda parts: F.transform(F.arrays_zip(parts.alias("p"), running(F.transform(parts, F.length)).alias("e")), of))
    return F.filter(cut, lambda x: x["text"] != "")


def sentence_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, SENTENCE_END, -1), lambda p: p.rlike(SPACE.replace("[", "[^", 1))))


def digit_ratio(c: Column) -> Column:
    return F.try_divide(F.length(F.regexp_replace(c, "[^0-9]", "")).cast("double"), F.length(c).cast("double"))


#: Phrases that show what an amount is about, by label; labels in the order in which ties are broken. Fixed values.
CONTEXTS = (
    ("drawdown", ("\\bdraw\\s*down\\b", "\\bdrawdown\\b", "\\bloCCS\\b", "\\bdisburs(?:ed|ement)\\b")),
    ("expended", ("\\bexpended\\b", "\\bspent\\b", "\\bexpenditures?\\b")),
    ("obligated", ("\\bobligat(?:ed|ion|ions)\\b", "\\bcommitt?ed\\b")),
    ("budget", ("\\bbudget\\b", "\\btotal budget\\b", "\\bproposed budget\\b", "\\bestimated\\b")),
)


def money_context(sentence: Column, start: Column, end: Column, heading: Column | None = None, reach: int = 90) -> Column:
    """label and confidence of an amount from the words around it: the label with most matching phrases."""
    low = F.greatest(start - reach, F.lit(0))
    window = F.lower(F.substr(sentence, low + 1, end + reach - low))
    window = window if heading is None else F.concat_ws(" ", F.lower(heading), window)
    scores = [sum((F.when(window.rlike("(?i)" + p), 1).otherwise(0) for p in phrases), F.lit(0)) for _, phrases in CONTEXTS]
    best = F.greatest(*scores)
    label = F.lit("unknown")
    for (name, _), score in reversed(list(zip(CONTEXTS, scores, strict=True))):
        label = F.when((score == best) & (best > 0), name).otherwise(label)
    confidence = F.when(best == 0, 0.1).when(best == 1, 0.75).otherwise(0.9)
    return F.struct(label.alias("label"), confidence.alias("confidence"))


def zip_codes(c: Column, least: int = 75000, most: int = 79999, widest: int = 100) -> Column:
    """Distinct five-digit codes, ranges 'a - b' expanded where they are narrow and lie in the given area;
    of other ranges the ends count."""
    ranges = F.transform(F.regexp_extract_all(c, F.lit("([0-9]{5}\\s*-\\s*[0-9]{5})"), F.lit(1)), lambda r: F.transform(F.split(r, "\\s*-\\s*"), lambda x: x.cast("int")))
    good = lambda r: (r[1] >= r[0]) & (r[1] - r[0] <= widest) & r[0].between(least, most) & r[1].between(least, most)
    wide = F.flatten(F.transform(ranges, lambda r: F.when(good(r), F.sequence(r[0], F.greatest(r[0], r[1]))).otherwise(r)))
    single = F.filter(F.transform(F.regexp_extract_all(c, F.lit("\\b([0-9]{5})\\b"), F.lit(1)), lambda x: x.cast("int")), lambda x: x.between(least, most))
    return F.transform(F.array_sort(F.array_distinct(F.concat(wide, single))), lambda x: F.lpad(x.cast("string"), 5, "0"))


def tract_code(c: Column) -> Column:
    """A census tract as six digits: 12.3 is 001230; longer codes stay as they are."""
    whole, part = F.split_part(c, F.lit("."), F.lit(1)), F.split_part(c, F.lit("."), F.lit(2))
    filled = F.concat(F.when(F.length(whole) < 4, F.lpad(whole, 4, "0")).otherwise(whole), F.when(F.length(part) < 2, F.rpad(part, 2, "0")).otherwise(part))
    return F.when(F.contains(c, F.lit(".")), filled).when(F.length(c) < 6, F.lpad(c, 6, "0")).otherwise(c)


def geoid(fips: Column, tract: Column, block_group: Column | None = None, state: str = "48") -> Column:
    parts = [F.lit(state), fips, tract_code(tract)] + ([] if block_group is None else [F.coalesce(block_group, F.lit(""))])
    return F.concat(*parts)


#: How entity types are read from text; each pattern has no groups. Fixed values.
ENTITY_PATTERNS = {
    "MONEY": "(?i:\\$[0-9,]+(?:\\.[0-9]{2})?(?:\\s*(?:million|billion|M|B))?)",
    "DAMAGE_METRIC": "(?i:[0-9]{1,3}(?:,[0-9]{3})*\\s+(?:homes?|households?|units?|structures?|people|residents|families|deaths?|fatalities|casualties))",
    "RAINFALL": "(?i:[0-9]+(?:\\.[0-9]+)?\\s*(?:inches?|in\\.?)\\s*(?:of\\s+)?(?:rain(?:fall)?)?)",
    "WIND_SPEED": "(?i:[0-9]+\\s*(?:mph|miles?\\s*per\\s*hour)\\s*(?:wind(?:s)?)?)",
    "QUARTER": "(?i:Q[1-4]\\s*[0-9]{4}|[0-9]{4}\\s*Q[1-4])",
    "FEMA_DECLARATION": "\\b(?:DR|FEMA)-[0-9]{4}\\b",
}


def entities(c: Column, patterns: dict[str, str] | None = None) -> Column:
    """Spans of all types: priority (the type's place in the list), start, end, type, text."""
    own = patterns or ENTITY_PATTERNS

    def of(priority: int, kind: str, pattern: str) -> Column:
        return F.transform(spans(c, pattern), lambda s: F.struct(F.lit(priority).alias("priority"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("type"), s["text"].alias("text")))

    return F.concat(*[of(k, kind, pattern) for k, (kind, pattern) in enumerate(own.items())])


#: Programs under their short names, and words that stay small in a disaster's name. Fixed values.
PROGRAMS = {
    "HAP": "Homeowner Assistance Program",
    "HRP": "Homeowner Reimbursement Program",
    "CDBG-DR": "Community Development Block Grant - Disaster Recovery",
    "CDBG-MIT": "Community Development Block Grant - Mitigation",
}
SMALL_WORDS = ("of", "and", "the", "in", "on")


def normalize_entity(kind: Column, text: Column) -> Column:
    """An entity's normal form: a declaration's number, a county as 'Name County', a program's long name, a
    disaster's name with small words small, else trimmed text."""
    own = F.trim(text)
    county = F.concat(F.initcap(F.trim(F.regexp_replace(F.lower(own), "\\s+county$", ""))), F.lit(" County"))
    program = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in PROGRAMS.items() for x in pair]), F.upper(own)), F.initcap(own))
    disaster = F.array_join(F.transform(words(F.lower(own)), lambda w: F.when(w.isin(*SMALL_WORDS), w).otherwise(F.initcap(w))), " ")
    return (
        F.when(kind == "FEMA_DECLARATION", extract(own, "([0-9]{4})")).when(kind == "GRANT_NUMBER", F.upper(own)).when(kind == "TX_COUNTY", county).when(kind == "PROGRAM", program)
        .when(kind == "DISASTER", disaster).otherwise(own)
    )
