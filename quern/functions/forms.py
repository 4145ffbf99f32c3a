"""Activity pages: grids of labels and values, numbers and titles that a layout spreads over lines, core statements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.rules import SWITCHES, first_of, has, squeezed
from quern.functions.text import extract, let, nullif_empty

CELLS = "array<array<string>>"


def read_grid(json: Column) -> Column:
    """Rows of cells from a table's JSON; null where it is none, or its first row is no list. A number reads as its value is printed (2.50 as 2.5)."""
    return F.when(json.rlike("^\\s*\\[\\s*\\["), F.from_json(json, CELLS))


def grid_fields(grid: Column) -> Column:
    """Map of a grid whose rows take turns as labels and values: a label ends with a colon, its value stands below it.

    Names are in lower case with underscores; an empty value is null, and so is one of a row that ends before it. Of a
    label that occurs again the last one counts; a last row of labels without values is left out."""

    def pair(own: Column, i: Column) -> Column:
        values = F.get(own, 2 * i + 1)

        def entry(label: Column, j: Column) -> Column:
            name = F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_"), "^_+|_+$", "")
            return F.struct(F.when(squeezed(label).endswith(":"), name).alias("key"), nullif_empty(squeezed(F.get(values, j))).alias("value"))

        return F.coalesce(F.filter(F.transform(F.get(own, 2 * i), entry), lambda e: e["key"].isNotNull()), F.array().cast("array<struct<key:string,value:string>>"))

    def fields(own: Column) -> Column:
        rows = F.floor(F.size(own) / 2).cast("int")
        pairs = F.flatten(F.transform(F.filter(F.sequence(F.lit(0), F.greatest(rows, F.lit(1)) - 1), lambda i: i < rows), lambda i: pair(own, i)))
        return let(pairs, lambda all_: F.map_from_entries(F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda later: later["key"] == e["key"]))))

    return F.when(grid.isNotNull(), let(grid, fields))


def grid_text(json: Column) -> Column:
    """A line for each cell of a grid, or of a plain list, that is not empty; '' where there is none."""
    cells = F.coalesce(F.flatten(F.filter(read_grid(json), lambda row: row.isNotNull())), F.from_json(json, "array<string>"))
    return F.coalesce(F.array_join(F.filter(F.transform(cells, squeezed), lambda c: c != ""), "\n"), F.lit(""))


# --- numbers and titles -------------------------------------------------------------------------------------

#: Words that are no number of an activity, amounts, the labels of number and title, and numbers that are known by their
#: form alone. Fixed values.
NO_CODES = ("projected", "overall", "activity", "na", "n/a")
AMOUNT_ALONE = "^\\$?[\\d,]+(?:\\.\\d{2})?$|^[\\d,]+(?:\\.\\d+)?$"
NUMBER_AND_TITLE = "(?i)Grantee Activity Number:\\s*([^\\n]+?)\\s+Activity Title:\\s*([^\\n]+)"
NUMBER_HERE, TITLE_HERE = "(?i)Grantee Activity Number:\\s*(\\S+)", "(?i)Activity Title:\\s*(.+)$"
KNOWN_NUMBERS = ("(?:^|\\n)\\s*(\\d{2}-\\d{3}-\\d{3}[^\\n]*)", "(?:^|\\n)\\s*(\\d{6,}[A-Za-z0-9_-]*-[A-Za-z][A-Za-z0-9_-]*)\\s*(?:\\n|$)", "(?i)(?:^|\\n)\\s*(GLO-[A-Za-z0-9_-]+)")
#: Lines after a label without a value among which number and title are looked for. Fixed value.
AHEAD = 7


def page_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\\r\\n?|\\n"), lambda x: F.trim(x)), lambda x: x != "")


def is_code(token: Column) -> Column:
    """Whether a word may be an activity's number: 3 to 120 characters, a digit or a 'GLO-' in front, no amount."""
    low = F.lower(token)
    return F.coalesce(F.length(token).between(3, 120) & ~token.endswith(":") & ~low.isin(*NO_CODES) & ~token.rlike(AMOUNT_ALONE) & (token.rlike("\\d") | low.startswith("glo-")), F.lit(False))


def code_and_title(text: Column) -> Column:
    """code and title of a page: on the line of both labels; or on the line of its own label, the title on the next; or,
    below labels without values, in the first of seven lines that begins with a number, the title after it."""

    def below(own: Column) -> Column:
        def of(line: Column, i: Column) -> Column:
            low, here = F.lower(line), extract(line, NUMBER_HERE)
            token = lambda x: F.regexp_replace(F.regexp_extract(x, "^\\S+", 0), "[,:;]+$", "")
            hit = F.get(F.filter(F.slice(own, i + 2, F.lit(AHEAD)), lambda x: ~x.endswith(":") & is_code(token(x))), F.lit(0))
            split = F.struct(F.when(is_code(here), here).alias("code"), squeezed(extract(F.get(own, i + 1), TITLE_HERE)).alias("title"))
            ahead = F.struct(token(hit).alias("code"), nullif_empty(squeezed(F.regexp_replace(hit, "^\\S+", ""))).alias("title"))
            return F.when(has(low, "grantee activity number"), F.when(here.isNotNull() & ~has(low, "activity title"), split).when(hit.isNotNull(), ahead))

        return F.get(F.filter(F.transform(own, of), lambda x: x.isNotNull()), F.lit(0))

    code = squeezed(F.regexp_extract(text, NUMBER_AND_TITLE, 1))
    one_line = F.struct(F.when(is_code(code), code).alias("code"), nullif_empty(squeezed(F.regexp_extract(text, NUMBER_AND_TITLE, 2))).alias("title"))
    return F.when(text.rlike(NUMBER_AND_TITLE), one_line).otherwise(let(page_lines(text), below))


def activity_number(text: Column) -> Column:
    """An activity's number by its label, else the first line that has the form of one."""
    return F.coalesce(code_and_title(text)["code"], *[squeezed(extract(text, p)) for p in KNOWN_NUMBERS])


#: Statuses that may end a line of category and status, and where a page's other fields stand. Fixed values.
STATUSES = ("Completed", "Under Way", "Cancelled", "Not Started")
CATEGORY = "(?i)Activity Category:\\s*Activity Status:\\s*\\n?([^\\n]+)"
DATE = "\\s*([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})"
PROJECT = "(?i)Project\\s*#\\s*/\\s*Project Title:\\s*([0-9A-Za-z_-]+)\\s*/"
LABELLED = {
    "responsible_organization": "Responsible Organization:\\s*([^\\n]+)",
    "benefit_type": "Benefit Type:\\s*([^\\n]+)",
    "national_objective": "National Objective:\\s*([^\\n]+)",
    "projected_start_date": "Projected Start Date:" + DATE,
    "projected_end_date": "Projected End Date:" + DATE,
    "completed_activity_actual_end_date": "Completed Activity Actual End Date:" + DATE,
}


def category_and_status(text: Column) -> Column:
    """category and status of the older layout, whose one line ends with the status."""

    def of(value: Column) -> Column:
        status = first_of([(F.lower(value).endswith(s.lower()), F.lit(s)) for s in STATUSES], F.lit(None).cast("string"))
        return F.struct(nullif_empty(F.trim(F.substr(value, F.lit(1), F.length(value) - F.coalesce(F.length(status), F.lit(0))))).alias("category"), status.alias("status"))

    return let(squeezed(extract(text, CATEGORY)), of)


def activity_block(text: Column) -> Column:
    """All fields of an activity's page; null where a field is absent."""
    kind, named = category_and_status(text), code_and_title(text)
    own = lambda pattern: squeezed(extract(text, pattern))
    return F.struct(
        named["code"].alias("grantee_activity_number"), named["title"].alias("activity_title"), kind["category"].alias("activity_type"), kind["status"].alias("activity_status"),
        F.coalesce(own("(?i)Project Number:\\s*([^\\n]+)"), own(PROJECT)).alias("project_number"), own("(?i)Project Title:\\s*([^\\n]+)").alias("project_title"),
        *[own("(?i)" + p).alias(name) for name, p in LABELLED.items()],
    )


# --- statements ---------------------------------------------------------------------------------------------

#: Longest core statement, longest one without a keyword, and when the sentence before joins in. Fixed values.
CORE, OTHER, BEFORE, SENTENCE, BOTH = 520, 420, 260, 320, (80, 520)


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def core_statement(snippet: Column, keyword: Column) -> Column:
    """The sentence with the keyword's first place, and the one before where both are short. Sentences end with . ; ? or !"""

    def of(s: Column) -> Column:
        place = lambda p: F.struct(F.regexp_instr(s, F.lit(p)).alias("at"), F.regexp_extract(s, p, 0).alias("word"))
        first = first_of([(keyword == k, place("(?i)" + p)) for k, p in SWITCHES], place("(?i)" + "|".join(p for _, p in SWITCHES)))

        def around(x: Column) -> Column:
            # what stands to the left is read from its end, so that a search never starts anew at each of its places
            left, right = F.reverse(F.substr(s, F.lit(1), x["at"] - 1)), F.substr(s, x["at"] + F.length(x["word"]))
            own = lambda k: F.reverse(F.regexp_extract(left, "^([^.;?!]*)([.;?!][^.;?!]*)?", k))
            core = squeezed(F.concat(own(1), x["word"], F.regexp_extract(right, "^[^.;?!]*[.;?!]?", 0)))
            return let(F.struct(core.alias("core"), squeezed(own(2)).alias("before")), joined)

        def joined(x: Column) -> Column:
            core, before = x["core"], x["before"]
            close = (before != "") & (F.length(before) <= BEFORE) & (F.length(core) <= SENTENCE)
            return let(F.when(close, F.concat_ws(" ", before, core)), lambda both: shortened(F.when(F.length(both).between(*BOTH), both).otherwise(core), CORE))

        return let(first, lambda x: F.when(x["at"] > 0, around(x)).otherwise(shortened(s, OTHER)))

    return let(squeezed(F.coalesce(snippet, F.lit(""))), of)
