"""Registered rollups over ledgers, entities and vectors that need more than one grouping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import rules as R
from quern.operators import finance as fin
from quern.operators import pages as P
from quern.plans.reports import mentions
from quern.registry import register
from quern.sources.tables import VIEWS, activities, allocations, table


def n():
    return F.count(F.lit(1)).cast("bigint")


def distinct(c):
    return F.count_distinct(c).cast("bigint")


def share(part, whole, digits=2):
    return F.coalesce(F.round(F.try_divide(part * 100.0, whole), digits), F.lit(0.0))


@register("largest_activities", VIEWS + "SELECT program_type, max(year * 10 + quarter_num) AS latest, arg_max(quarter, (year * 10 + quarter_num, id)) AS quarter, arg_max(id, (year * 10 + quarter_num, id)) AS id FROM activities GROUP BY 1")
def largest_activities(spark, d):
    """The row that holds the maximum, ties to the larger id."""
    at = F.col("year") * 10 + F.col("quarter_num")
    return activities(spark, d).groupBy("program_type").agg(F.max(at).alias("latest"), F.max_by("quarter", F.struct(at, "id")).alias("quarter"), F.max_by("id", F.struct(at, "id")).alias("id"))


@register("dependent_columns", VIEWS + "SELECT quarter, min(year) AS year, min(quarter_num) AS quarter_num, count(*) AS n FROM activities GROUP BY 1")
def dependent_columns(spark, d):
    """Columns that depend on the key are taken by min."""
    return activities(spark, d).groupBy("quarter").agg(F.min("year").alias("year"), F.min("quarter_num").alias("quarter_num"), n().alias("n"))


NARRATIVE = "(SELECT year(o_orderdate) AS year, quarter(o_orderdate) AS quarter_num, o_orderkey % 40 AS k FROM orders)"


@register("narrative_trend", f"SELECT CAST(year AS INTEGER) AS year, CAST(quarter_num AS INTEGER) AS quarter_num, count(*) AS narratives, count(*) FILTER (k % 2 = 0) AS with_projects, CAST(sum(k) FILTER (k % 2 = 0) AS BIGINT) AS projects, CAST(sum(k) FILTER (k % 2 = 1) AS BIGINT) AS households FROM {NARRATIVE} GROUP BY 1, 2")
def narrative_trend(spark, d):
    """Narratives are written, read by the rules, and counted by quarter."""
    k = F.col("o_orderkey") % 40
    text = F.concat(F.lit("Activity Progress Narrative: This quarter "), F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit(" homes were completed."))).otherwise(F.concat(F.lit("we served "), k.cast("string"), F.lit(" households."))), F.lit(" No Activity Locations"))
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter_num"), R.narrative_metrics(R.narrative(text)).alias("x"))
    return o.groupBy("year", "quarter_num").agg(n().alias("narratives"), F.count("x.projects_completed").cast("bigint").alias("with_projects"), F.sum("x.projects_completed").alias("projects"), F.sum("x.households_served").alias("households"))


@register(
    "extended_summary",
    VIEWS + """SELECT (SELECT count(DISTINCT subrecipient_id) FROM allocations) AS subrecipients, (SELECT count(DISTINCT zip) FROM allocations) AS zips, (SELECT round(sum(allocated), 2) FROM allocations WHERE is_buyout) AS buyouts,
(SELECT round(sum(households), 2) FROM allocations WHERE quarter = (SELECT max_by(quarter, year * 10 + quarter_num) FROM allocations)) AS latest_households, (SELECT count(DISTINCT activity_type) FROM activities) AS types""",
)
def extended_summary(spark, d):
    """One-row aggregates side by side."""
    given = allocations(spark, d)
    latest = given.agg(F.max(F.struct("year", "quarter_num")).alias("q"))
    main = given.agg(distinct("subrecipient_id").alias("subrecipients"), distinct("zip").alias("zips"), fin.money(F.sum(F.when(F.col("is_buyout"), F.col("allocated")))).alias("buyouts"))
    recent = given.join(F.broadcast(latest), F.struct("year", "quarter_num") == F.col("q")).agg(fin.money(F.sum("households")).alias("latest_households"))
    types = activities(spark, d).agg(distinct("activity_type").alias("types"))
    return main.crossJoin(F.broadcast(recent)).crossJoin(F.broadcast(types))  # one row each


@register(
    "parse_statistics",
    VIEWS + """SELECT * FROM (SELECT 'organization' AS kind, responsible_org AS name, count(*) AS n FROM activities WHERE responsible_org IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'county', county, count(*) FROM activities WHERE county IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10) UNION ALL SELECT 'status', status, count(*) FROM activities GROUP BY 2""",
)
def parse_statistics(spark, d):
    """The ten most frequent organisations and counties, and all statuses."""
    a = activities(spark, d)
    by = lambda c, kind: a.where(f"{c} is not null").groupBy(F.lit(kind).alias("kind"), F.col(c).alias("name")).agg(n().alias("n"))
    top = lambda df: df.orderBy(F.desc("n"), "name").limit(10)
    return top(by("responsible_org", "organization")).unionByName(top(by("county", "county"))).unionByName(by("status", "status"))


@register("document_statistics", "SELECT source, lang, count(*) AS documents, CAST(sum(coalesce(n_chars, 0)) AS BIGINT) AS chars, count(*) FILTER (n_chars < 100) AS short FROM documents GROUP BY 1, 2")
def document_statistics(spark, d):
    """A28, S7's rule: by category, missing sizes as 0; texts of fewer than 100 characters need another reading."""
    return table(spark, d, "documents").groupBy("source", "lang").agg(n().alias("documents"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("chars"), F.count_if(F.col("n_chars") < 100).cast("bigint").alias("short"))


@register("topic_trends", "SELECT label AS topic, CAST(vec_id % 8 AS BIGINT) AS quarter, count(*) AS chunks, count(DISTINCT vec_id // 16) AS documents FROM embeddings GROUP BY 1, 2")
def topic_trends(spark, d):
    """A30, A45."""
    return table(spark, d, "embeddings").groupBy(F.col("label").alias("topic"), (F.col("vec_id") % 8).alias("quarter")).agg(n().alias("chunks"), distinct(F.expr("vec_id div 16")).alias("documents"))


@register("money_totals", VIEWS + "SELECT activity_code, status, count(*) AS n, round(sum(CASE WHEN county IS NOT NULL THEN total_budget END), 2) AS known, round(sum(CASE WHEN county IS NOT NULL THEN total_budget ELSE 0 END), 2) AS known_or_zero, round(max(total_budget), 2) AS largest FROM activities GROUP BY 1, 2")
def money_totals(spark, d):
    """A sum of nothing but missing amounts is missing; where they count as 0 it is 0."""
    known = F.when(F.col("county").isNotNull(), F.col("total_budget"))
    return activities(spark, d).groupBy("activity_code", "status").agg(n().alias("n"), fin.money(F.sum(known)).alias("known"), fin.money(F.sum(F.coalesce(known, F.lit(0.0)))).alias("known_or_zero"), F.round(F.max("total_budget"), 2).alias("largest"))


@register("cells", "SELECT CAST(c_custkey % 97 AS BIGINT) AS cell, count(*) AS size, count(DISTINCT c_nationkey) AS nations, array_to_string(list_sort(list(c_custkey)), ',') AS ids FROM customer GROUP BY 1")
def cells(spark, d):
    """By cell the number of rows, of distinct values, and the members."""
    return table(spark, d, "customer").groupBy((F.col("c_custkey") % 97).alias("cell")).agg(n().alias("size"), distinct("c_nationkey").alias("nations"), F.array_join(F.array_sort(F.collect_list("c_custkey")).cast("array<string>"), ",").alias("ids"))


def rates(column: str) -> str:
    return f"""SELECT '{column}' AS kind, coalesce(CAST({column} AS VARCHAR), 'unknown') AS name, CAST(sum(c) AS BIGINT) AS total, CAST(coalesce(sum(c) FILTER (status = 'Completed'), 0) AS BIGINT) AS completed,
  round(coalesce(sum(c) FILTER (status = 'Completed'), 0) * 100.0::DOUBLE / sum(c), 2) AS completion_rate FROM (SELECT {column}, status, count(DISTINCT activity_code) AS c FROM allocations WHERE quarter = (SELECT max_by(quarter, year * 10 + quarter_num) FROM allocations) GROUP BY 1, 2) GROUP BY 2"""


@register("completion_by_kind", VIEWS + " UNION ALL ".join(map(rates, ("org_type", "activity_type", "is_buyout"))))
def completion_by_kind(spark, d):
    """Of the latest quarter, distinct activities by status, folded to a rate; an activity counts once in each status."""
    given = allocations(spark, d)
    now = fin.in_latest_quarter(given)
    out = None
    for c in ("org_type", "activity_type", "is_buyout"):
        counted = now.groupBy(c, "status").agg(F.count_distinct("activity_code").alias("c"))
        done = F.coalesce(F.sum(F.when(F.col("status") == "Completed", F.col("c"))), F.lit(0))
        one = counted.groupBy(F.lit(c).alias("kind"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("name")).agg(F.sum("c").alias("total"), done.alias("completed"), share(done, F.sum("c")).alias("completion_rate"))
        out = one if out is None else out.unionByName(one)
    return out


@register("completion_trend", VIEWS + "SELECT quarter, count(DISTINCT activity_code) AS total, count(*) FILTER (status = 'Completed') AS completed, round(count(*) FILTER (status = 'Completed') * 100.0::DOUBLE / count(DISTINCT activity_code), 2) AS completion_rate FROM activities GROUP BY 1")
def completion_trend(spark, d):
    """Distinct activities, but completed rows; the rate may pass 100."""
    done = F.count_if(F.col("status") == "Completed")
    return activities(spark, d).groupBy("quarter").agg(distinct("activity_code").alias("total"), done.cast("bigint").alias("completed"), share(done, F.count_distinct("activity_code")).alias("completion_rate"))


@register("confidence_counts", "SELECT o_custkey, count(*) FILTER (o_orderpriority < '2') AS high, count(*) FILTER (o_orderpriority >= '2' AND o_orderpriority < '4') AS medium, count(*) FILTER (o_orderpriority >= '4') AS low FROM orders GROUP BY 1")
def confidence_counts(spark, d):
    """A43."""
    p = F.col("o_orderpriority")
    count = lambda c: F.count_if(c).cast("bigint")
    return table(spark, d, "orders").groupBy("o_custkey").agg(count(p < "2").alias("high"), count((p >= "2") & (p < "4")).alias("medium"), count(p >= "4").alias("low"))


@register("split_values", "SELECT w AS value, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part) WHERE length(w) BETWEEN 3 AND 80 GROUP BY 1")
def split_values(spark, d):
    """A44, P11."""
    return table(spark, d, "part").select(F.explode(F.split("p_type", " ")).alias("value")).where(F.length("value").between(3, 80)).groupBy("value").agg(n().alias("n"))


@register("cumulative_households", VIEWS + "SELECT activity_code, max(h) AS households FROM (SELECT activity_code, quarter, sum(households) AS h FROM allocations WHERE regexp_matches(zip, '^\\d{5}$') GROUP BY 1, 2) GROUP BY 1")
def cumulative_households(spark, d):
    """Totals are cumulative, so the largest of the quarters' sums counts."""
    by = allocations(spark, d).where(F.col("zip").rlike("^\\d{5}$")).groupBy("activity_code", "quarter").agg(F.sum("households").alias("h"))
    return by.groupBy("activity_code").agg(F.max("h").alias("households"))


@register("best_snippets", "SELECT l_orderkey, lower(l_returnflag) AS snippet, l_linenumber, l_quantity AS score FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, lower(l_returnflag) ORDER BY l_quantity DESC, l_linenumber) = 1")
def best_snippets(spark, d):
    """W12."""
    own = table(spark, d, "lineitem").select("l_orderkey", F.lower("l_returnflag").alias("snippet"), "l_linenumber", F.col("l_quantity").alias("score"))
    return P.best(own, ["l_orderkey", "snippet"], F.desc("score"), "l_linenumber")


@register(
    "quarters_of_top_entities",
    "WITH m AS (SELECT 'n' || (l_partkey % 20) AS name, l_linenumber % 4 AS q FROM lineitem), t AS (SELECT name FROM m GROUP BY 1 ORDER BY count(*) DESC, name LIMIT 5) SELECT name, count(*) FILTER (q = 0) AS q0, count(*) FILTER (q = 1) AS q1, count(*) FILTER (q = 2) AS q2, count(*) FILTER (q = 3) AS q3 FROM m WHERE name IN (FROM t) GROUP BY 1",
)
def quarters_of_top_entities(spark, d):
    """The most frequent names overall, then a pivot by quarters in their order."""
    m = mentions(spark, d).select("name", F.concat(F.lit("q"), F.col("start") % 4).alias("q"))
    top = m.groupBy("name").agg(n().alias("n")).orderBy(F.desc("n"), "name").limit(5)
    return m.join(F.broadcast(top), "name", "left_semi").groupBy("name").pivot("q", ["q0", "q1", "q2", "q3"]).agg(n()).fillna(0)


@register("occurrences", VIEWS + "SELECT activity_code, arg_min(quarter, (year * 10 + quarter_num, id)) AS first_quarter, arg_max(quarter, (year * 10 + quarter_num, id)) AS last_quarter, count(DISTINCT quarter) AS quarters FROM activities GROUP BY 1")
def occurrences(spark, d):
    """W17."""
    at = F.struct(F.col("year") * 10 + F.col("quarter_num"), "id")
    return activities(spark, d).groupBy("activity_code").agg(F.min_by("quarter", at).alias("first_quarter"), F.max_by("quarter", at).alias("last_quarter"), distinct("quarter").alias("quarters"))


@register("ranked_with_missing_last", VIEWS + "SELECT id, county, row_number() OVER (ORDER BY CASE status WHEN 'Completed' THEN 0 WHEN 'Under Way' THEN 1 ELSE 2 END, county DESC NULLS LAST, id) AS position FROM activities QUALIFY position <= 100")
def ranked_with_missing_last(spark, d):
    """An order of one's own, then missing values last in either direction."""
    rank = F.when(F.col("status") == "Completed", 0).when(F.col("status") == "Under Way", 1).otherwise(2)
    first = activities(spark, d).orderBy(rank, F.col("county").desc_nulls_last(), "id").limit(100)
    # of a hundred rows
    order = Window.orderBy(rank, F.col("county").desc_nulls_last(), "id")
    return first.select("id", "county", F.row_number().over(order).cast("bigint").alias("position"))


@register("distinct_in_order", "SELECT o_custkey, list(status ORDER BY k) AS statuses FROM (SELECT o_custkey, o_orderstatus AS status, min(o_orderkey) AS k FROM orders GROUP BY 1, 2) GROUP BY 1")
def distinct_in_order(spark, d):
    """O-DEDUP-3: each value once, where it first stands."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: x["o_orderstatus"])
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_distinct(ordered).alias("statuses"))


@register("distinct_places", "SELECT c_nationkey AS page, round(c_acctbal / 1000, 1) + 0 AS lat, min(c_custkey) AS id, count(*) AS n FROM customer GROUP BY 1, 2")
def distinct_places(spark, d):
    """O-DEDUP-4: places are one if they are equal when rounded."""
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("page"), (F.round(F.col("c_acctbal") / 1000, 1) + 0).alias("lat")).agg(F.min("c_custkey").alias("id"), n().alias("n"))


@register("first_of_each_link", "SELECT min(l_linenumber) AS id, l_orderkey, l_returnflag, l_linestatus FROM lineitem GROUP BY 2, 3, 4")
def first_of_each_link(spark, d):
    """O-DEDUP-1, O-DEDUP-2, O-DEDUP-5: of rows with equal keys the smallest id stays."""
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(F.min("l_linenumber").alias("id"))


@register(
    "long_by_quarter",
    VIEWS + """SELECT 'money' AS measure, quarter, status AS name, count(*) AS n, round(sum(total_budget), 2) AS amount FROM activities GROUP BY 2, 3 UNION ALL SELECT 'households', quarter, org_type, count(*), round(sum(households), 2) FROM allocations GROUP BY 2, 3
UNION ALL SELECT 'severity', quarter, activity_type, count(*), round(max(total_budget), 2) FROM activities GROUP BY 2, 3""",
)
def long_by_quarter(spark, d):
    """Measures by quarter, one below the other."""
    a, given = activities(spark, d), allocations(spark, d)
    one = lambda df, measure, name, amount: df.groupBy(F.lit(measure).alias("measure"), "quarter", F.col(name).alias("name")).agg(n().alias("n"), F.round(amount, 2).alias("amount"))
    return one(a, "money", "status", F.sum("total_budget")).unionByName(one(given, "households", "org_type", F.sum("households"))).unionByName(one(a, "severity", "activity_type", F.max("total_budget")))


@register("money_view", VIEWS + "SELECT DISTINCT activity_code, status, round(total_budget, 2) AS amount, responsible_org FROM activities WHERE status = 'Completed' AND total_budget >= 1000 AND responsible_org ILIKE '%1%' ORDER BY amount DESC, activity_code, responsible_org LIMIT 200")
def money_view(spark, d):
    """Amounts by context, least amount and a part of a name."""
    found = activities(spark, d).where((F.col("status") == "Completed") & (F.col("total_budget") >= 1000) & F.col("responsible_org").ilike("%1%"))
    return found.select("activity_code", "status", F.round("total_budget", 2).alias("amount"), "responsible_org").distinct().orderBy(F.desc("amount"), "activity_code", "responsible_org").limit(200)


@register("panel_place_quarter", VIEWS + "SELECT zip, quarter, count(DISTINCT activity_code) AS activities, round(sum(allocated), 2) AS allocated, count(*) FILTER (status = 'Completed') AS completed, count(*) FILTER (status = 'Under Way') AS under_way, round_even(count(*) FILTER (status = 'Completed')::DOUBLE / count(*), 4) AS completion_rate FROM allocations GROUP BY GROUPING SETS ((zip, quarter), (quarter))")
def panel_place_quarter(spark, d):
    """By place and quarter, and over all places of a quarter."""
    done = F.count_if(F.col("status") == "Completed")
    sets = allocations(spark, d).groupingSets([["zip", "quarter"], ["quarter"]], "zip", "quarter")
    return sets.agg(distinct("activity_code").alias("activities"), fin.money(F.sum("allocated")).alias("allocated"), done.cast("bigint").alias("completed"), F.count_if(F.col("status") == "Under Way").cast("bigint").alias("under_way"), F.bround(done.cast("double") / F.count(F.lit(1)), 4).alias("completion_rate")).select("zip", "quarter", "activities", "allocated", "completed", "under_way", "completion_rate")


DISTANCE = "list_distance(embedding::DOUBLE[], c)"


@register("representatives", f"WITH x AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(v) AS v FROM x GROUP BY 1, 2), c AS (SELECT label, list(v ORDER BY i) AS c FROM m GROUP BY 1) SELECT label, vec_id, rank FROM (SELECT label, vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY round({DISTANCE}, 9), vec_id) AS INTEGER) AS rank FROM embeddings JOIN c USING (label)) WHERE rank <= 5")
def representatives(spark, d):
    """V7: the five vectors of a cluster that lie nearest to its centre."""
    e = table(spark, d, "embeddings").where("embedding is not null")
    mean = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    centre = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("c"))
    square = F.aggregate(F.zip_with("embedding", "c", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda x, y: x + y)
    near = e.join(centre, "label").withColumn("distance", F.round(F.sqrt(square), 9))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("distance", "vec_id"))
    return near.withColumn("rank", rank).where("rank <= 5").select("label", "vec_id", "rank")


@register("latest_model", "SELECT label AS kind, max(vec_id) AS id, count(*) AS versions FROM embeddings GROUP BY 1")
def latest_model(spark, d):
    """V8: the latest version of each kind is the one of the largest id."""
    return table(spark, d, "embeddings").groupBy(F.col("label").alias("kind")).agg(F.max("vec_id").alias("id"), n().alias("versions"))


@register("index_metadata", "SELECT vec_id, CAST(vec_id // 256 AS BIGINT) AS batch, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM embeddings LEFT JOIN documents ON doc_id = vec_id")
def index_metadata(spark, d):
    """V2: vectors in batches of 256 with their metadata; what is missing is ''."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source")
    return table(spark, d, "embeddings").select("vec_id").join(docs, "vec_id", "left").select("vec_id", F.expr("vec_id div 256").alias("batch"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))


@register("entity_totals", "SELECT kind, count(*) AS mentions, count(DISTINCT name) AS names, count(DISTINCT u) AS documents, round(count(*)::DOUBLE / count(DISTINCT u), 4) AS per_document FROM (SELECT l_orderkey AS u, CASE l_linestatus WHEN 'F' THEN 'ORG' ELSE CASE WHEN l_partkey % 2 = 0 THEN 'TX_COUNTY' ELSE 'MONEY' END END AS kind, 'n' || (l_partkey % 20) AS name FROM lineitem) GROUP BY 1")
def entity_totals(spark, d):
    """Mentions by type, distinct names, and by document."""
    return mentions(spark, d).groupBy("kind").agg(n().alias("mentions"), distinct("name").alias("names"), distinct("u").alias("documents"), F.round(F.try_divide(F.count(F.lit(1)).cast("double"), F.count_distinct("u")), 4).alias("per_document"))


@register("guarded_exclusion", "SELECT count(*) AS kept FROM (SELECT CASE WHEN n_nationkey % 5 > 0 THEN n_name END AS m FROM nation) WHERE (m IS NULL OR NOT contains(m, 'A')) AND (m IS NULL OR m NOT IN ('PERU', 'CHINA'))")
def guarded_exclusion(spark, d):
    """What is missing is not excluded."""
    m = table(spark, d, "nation").select(F.when(F.col("n_nationkey") % 5 > 0, F.col("n_name")).alias("m"))
    return m.where((F.col("m").isNull() | ~F.contains("m", F.lit("A"))) & (F.col("m").isNull() | ~F.col("m").isin("PERU", "CHINA"))).agg(n().alias("kept"))


@register("pages_in_range", VIEWS + "SELECT id, program_type, quarter FROM activities WHERE year BETWEEN 1993 AND 1995 AND program_type IN ('BUILDING', 'MACHINERY') AND status = 'Completed' ORDER BY id LIMIT 50")
def pages_in_range(spark, d):
    """Categories, a range, an equality, an order and a limit."""
    a = fin.filtered(activities(spark, d), status="Completed")
    return a.where(F.col("year").between(1993, 1995) & F.col("program_type").isin("BUILDING", "MACHINERY")).select("id", "program_type", "quarter").orderBy("id").limit(50)
