"""Registered queries over groups, clusters, topics, offsets and tables that are written step by step."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import rules as R
from quern.functions import text as T
from quern.operators import density, dictionary, finance, pages, resolve, spatial, stages, topics, vectors
from quern.operators import documents as docs_
from quern.registry import register
from quern.sources import lookups, sinks
from quern.sources.tables import table


@register("density_clusters")
def density_clusters(spark, d):
    """V9: vectors in clusters of at least ten, or outliers."""
    return density.clusters(table(spark, d, "embeddings"))


@register("cluster_movement")
def cluster_movement(spark, d):
    """A45 over V9: each cluster's quarters, with distinct texts and the share of texts that speak of change. A vector's
    text is the document of its number, its quarter that of the order of its number. Four steps of distance."""
    found = density.clusters(table(spark, d, "embeddings"), levels=4)
    docs = density.told_apart(table(spark, d, "documents")).withColumnRenamed("doc_id", "vec_id")
    dates = table(spark, d, "orders").select(F.col("o_orderkey").alias("vec_id"), F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"))
    return density.movement_by_quarter(found.join(docs, "vec_id", "left").join(dates, "vec_id"))


@register("settled_groups")
def settled_groups(spark, d):
    """O-DEDUP-7, V10: near vectors of one label in groups, the smallest number first."""
    return vectors.settled_groups(table(spark, d, "embeddings").withColumn("score", -F.col("vec_id").cast("double")), 0.6)


_STOP = ", ".join(f"'{w}'" for w in topics.STOP)


@register(
    "topic_terms",
    rf"""WITH d AS (SELECT doc_id, source, list_filter(regexp_extract_all(lower(coalesce(text, '')), '{topics.RUN}'), lambda w: regexp_matches(w, '{topics.WORD}') AND w NOT IN ({_STOP})) AS w FROM documents),
t AS (SELECT doc_id, source, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM d),
v AS (SELECT term FROM t GROUP BY 1 ORDER BY count(*) DESC, term LIMIT {topics.VOCABULARY}),
f AS (SELECT doc_id, source, term, count(*) AS tf FROM t JOIN v USING (term) GROUP BY ALL), g AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
w AS (SELECT doc_id, source, term, tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1.0::DOUBLE) AS w FROM f JOIN g USING (term)),
n AS (SELECT doc_id, source, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w), s AS (SELECT source, count(*) AS size FROM documents GROUP BY 1),
m AS (SELECT source, term, round(sum(w) / any_value(size), 9) AS w FROM n JOIN s USING (source) GROUP BY 1, 2),
r AS (SELECT source, term, row_number() OVER (PARTITION BY source ORDER BY w DESC, term) AS k FROM m QUALIFY k <= 10),
l AS (SELECT source, list(term ORDER BY k) AS ts FROM r GROUP BY 1)
SELECT source, size, coalesce(array_to_string(ts[1:3], ' / '), 'Topic ' || source) AS label, coalesce(array_to_string(ts, ', '), '') AS terms FROM s LEFT JOIN l USING (source)""",
)
def topic_terms(spark, d):
    """V6: what each source's documents are about."""
    return topics.topic_terms(table(spark, d, "documents"), "source")


@register(
    "line_offsets",
    r"""WITH l AS (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS line_no, len(p) AS n FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]') AS p FROM documents)),
c AS (SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(line, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '[ \t\n\x{00A0}]+', ' ', 'g')) AS line FROM l WHERE line_no < n - 1 OR line <> ''),
o AS (SELECT *, coalesce(sum(CASE WHEN line <> '' THEN length(line) + 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c),
w AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '[ \t\n\x{00A0}]+', ' ', 'g')) AS clean FROM documents),
j AS (SELECT doc_id, string_agg(line, ' ' ORDER BY line_no) AS joined FROM c WHERE line <> '' GROUP BY 1)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, coalesce(joined = clean, false) AS aligned,
  CAST(CASE WHEN NOT coalesce(joined = clean, false) THEN 0 WHEN line <> '' THEN b ELSE greatest(b - 1, 0) END AS BIGINT) AS start, CAST(CASE WHEN NOT coalesce(joined = clean, false) THEN length(clean) WHEN line <> '' THEN b + length(line) ELSE greatest(b - 1, 0) END AS BIGINT) AS "end",
  CASE WHEN joined = clean THEN line ELSE clean END AS reads FROM o JOIN w USING (doc_id) LEFT JOIN j USING (doc_id)""",
)
def line_offsets(spark, d):
    """where each line stands in its document's clean text, and what the clean text has there."""
    docs = table(spark, d, "documents").select("doc_id", "text", T.clean_text(F.col("text")).alias("clean"))
    found = pages.line_offsets(docs, ["doc_id"], "text", "clean")
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "start", "end", "aligned")).alias("spans"))
    read = F.transform("spans", lambda s: s.withField("reads", F.substr(F.col("clean"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return docs.join(spans, "doc_id").select("doc_id", F.inline(read))


@register(
    "values_used_once",
    """WITH RECURSIVE e AS (SELECT event_id, user_id, value, event_id % 3 = 0 AS sets, event_id % 5 < 2 AS uses, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
r(user_id, rn, kept, used) AS (SELECT user_id, rn, CASE WHEN sets AND NOT uses THEN value END, CASE WHEN sets AND uses THEN value END FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.rn, CASE WHEN e.uses THEN NULL WHEN e.sets THEN value ELSE kept END, CASE WHEN e.uses THEN CASE WHEN e.sets THEN value ELSE kept END END FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT event_id, user_id, used FROM r JOIN e USING (user_id, rn)""",
)
def values_used_once(spark, d):
    """A kept value goes to the first event that uses it, and is gone then."""
    e = table(spark, d, "events")
    return spatial.carried_once(e, ["user_id"], "event_id", "event_id % 3 = 0", "value", "event_id % 5 < 2", "used").select("event_id", "user_id", "used")


@register(
    "rewritten_lines",
    r"""SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, length(line) AS n, CASE WHEN doc_id % 7 = 0 AND line_no = 0 THEN 'by hand' END AS override_kind
FROM (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS line_no FROM (SELECT doc_id, string_split(CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || 'more' ELSE text END, chr(10)) AS p FROM documents))""",
)
def rewritten_lines(spark, d):
    """K8: a table of lines is made, some of it is marked by hand, a third of the documents change; the second run writes
    those alone, keeps the marks, and a third run finds nothing to do."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\nmore"))).otherwise(F.col("text")))
    base = stages.folder(spark, "lines")
    marked = F.when((F.col("doc_id") % 7 == 0) & (F.col("line_no") == 0), "by hand")
    lines = lambda x, mark: docs_.lines(x).select("doc_id", "line_no", F.length("line").cast("long").alias("n"), mark.cast("string").alias("override_kind"))
    write = lambda x, mark: sinks.processed(x, f"{base}/lines", f"{base}/ledger", "doc_id", ["text"], lambda y: lines(y, mark), ["doc_id", "line_no"], ("override_kind",), 8)
    write(docs, marked)
    write(changed, F.lit(None))
    write(changed, F.lit(None))
    return spark.read.parquet(f"{base}/lines").drop("part")


@register(
    "fund_switch_statements",
    r"""WITH o AS (SELECT *, o_orderkey % 3 AS form, o_custkey % 4 AS orgs, ['reallocated', 'reprogrammed', 'redirected'][1 + o_orderkey % 3] AS verb FROM orders),
s AS (SELECT o_orderkey, orgs, ['reallocat', 'reprogram', 'redirect'][1 + o_orderkey % 3] AS keyword, form = 0 AS from_to, o_orderkey % 2 = 0 AS amount, o_orderkey % 5 = 0 AS reason, o_orderpriority, o_orderstatus FROM o)
SELECT keyword, score, CASE WHEN score >= 5 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS confidence, "from", count(*) AS statements, CAST(sum(o_orderkey) AS BIGINT) AS keys
FROM (SELECT *, CASE WHEN from_to THEN 'program ' || o_orderpriority END AS "from", 2 * from_to::INT + 2 * amount::INT + (orgs >= 2)::INT + reason::INT AS score FROM s WHERE orgs >= 2 OR from_to) GROUP BY ALL""",
)
def fund_switch_statements(spark, d):
    """A statement for each order, read by the rule of F42; organisations of a page are a customer's number % 4."""
    verb = F.element_at(F.array(*map(F.lit, ("reallocated", "reprogrammed", "redirected"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    way = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" from program "), "o_orderpriority", F.lit(" to status "), "o_orderstatus")).otherwise("")
    amount = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(", $"), F.format_number("o_totalprice", 2))).otherwise("")
    why = F.when(F.col("o_orderkey") % 5 == 0, "; this was done because of need").otherwise("")
    text = F.concat(F.lit("The budget of this order was  "), verb, way, F.lit("; so it was decided"), amount, why, F.lit("."))
    read = table(spark, d, "orders").select("o_orderkey", R.fund_switch(text, (F.col("o_custkey") % 4).cast("int")).alias("x")).where("x.keyword IS NOT NULL").select("o_orderkey", "x.*")
    return read.groupBy("keyword", "score", "confidence", "from").agg(F.count("*").alias("statements"), F.sum("o_orderkey").alias("keys"))


#: Names for the dictionary queries: of each benchmark item its first word, its second and third, and its fourth to sixth.
_NAMES = r"""b AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark),
n AS (SELECT DISTINCT kind, name FROM (SELECT 'DISASTER' AS kind, w[1] AS name FROM b UNION ALL SELECT 'PROGRAM', array_to_string(w[2:3], ' ') FROM b UNION ALL SELECT 'TX_COUNTY', array_to_string(w[4:6], ' ') FROM b) WHERE name <> '')"""


def _dictionary(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit("([\\p{L}\\p{N}_]+)"), F.lit(1))
    cut = table(spark, d, "benchmark").select(words.alias("w"))
    kinds = (("DISASTER", 1, 1), ("PROGRAM", 2, 2), ("TX_COUNTY", 4, 3))
    made = F.array(*[F.struct(F.lit(k).alias("type"), F.array_join(F.slice("w", at, n), " ").alias("name")) for k, at, n in kinds])
    return cut.select(F.inline(made)).where("name <> ''")


@register(
    "dictionary_mentions",
    rf"""WITH {_NAMES}, d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM documents),
g AS (SELECT doc_id, array_to_string(w[i:i + k - 1], ' ') AS name FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (VALUES (1), (2), (3)) v(k) WHERE len(w) >= k))
SELECT kind AS type, name, count(*) AS mentions, count(DISTINCT doc_id) AS documents FROM g JOIN n USING (name) GROUP BY 1, 2""",
)
def dictionary_mentions(spark, d):
    """F8, T4: every mention of every name of the dictionary, counted by name."""
    found = dictionary.mentions(table(spark, d, "documents"), _dictionary(spark, d), ["DISASTER", "PROGRAM", "TX_COUNTY"], settle=False)
    return found.groupBy("type", "name").agg(F.count("*").alias("mentions"), F.countDistinct("doc_id").alias("documents"))


@register("dictionary_entities")
def dictionary_entities(spark, d):
    """Names in texts, none overlapping another, disasters before programs before counties."""
    return dictionary.mentions(table(spark, d, "documents"), _dictionary(spark, d), ["DISASTER", "PROGRAM", "TX_COUNTY"])


_POINT = "25.8 + (c_custkey * 53 % 1080) / 100.0 AS lat, -107.0 + (c_custkey * 37 % 1400) / 100.0 AS lon"


@register(
    "cells_by_level",
    f"""WITH p AS (SELECT CAST(floor((90 - lat::DOUBLE) / 180 * 256) AS INTEGER) AS y, CAST(floor((lon::DOUBLE + 180) / 360 * 256) AS INTEGER) AS x, c_custkey FROM (SELECT c_custkey, {_POINT} FROM customer)),
c AS (SELECT array_to_string(list_transform(range(7, -1, -1), lambda i: ((x >> CAST(i AS INTEGER)) & 1) + 2 * ((y >> CAST(i AS INTEGER)) & 1)), '') AS cell, c_custkey FROM p)
SELECT level, left(cell, level) AS cell, left(cell, level - 1) AS parent, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS total FROM c, (VALUES (4), (6), (8)) v(level) GROUP BY ALL""",
)
def cells_by_level(spark, d):
    """Customers by cells of three levels, a cell's parent by its name."""
    points = table(spark, d, "customer").select("c_custkey", (F.lit(25.8) + (F.col("c_custkey") * 53 % 1080) / 100).alias("lat"), (F.lit(-107.0) + (F.col("c_custkey") * 37 % 1400) / 100).alias("lon"))
    return spatial.cells_by_level(points, "lat", "lon", [4, 6, 8], "c_custkey")


@register(
    "funding_tree",
    """WITH a AS (SELECT c_mktsegment AS p, n_name AS n, o_orderpriority AS k, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
b AS (SELECT p, n, CAST(sum(value) AS BIGINT) AS value, list({'name': k, 'value': value} ORDER BY k) AS children FROM a GROUP BY ALL),
c AS (SELECT p, CAST(sum(value) AS BIGINT) AS value, list({'name': n, 'value': value, 'children': children} ORDER BY n) AS children FROM b GROUP BY 1)
SELECT p AS name, value, CAST(to_json({'name': p, 'value': value, 'children': children}) AS VARCHAR) AS json FROM c""",
)
def funding_tree(spark, d):
    """Segments, their nations and priorities as one nested document each, in cents."""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    customers = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey").join(F.broadcast(nations), "c_nationkey")
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return finance.nested(orders.join(customers, "c_custkey"), ["c_mktsegment", "n_name", "o_orderpriority"], "cents")


@register(
    "kept_lookups",
    """SELECT k.key, coalesce(c_mktsegment, s_name, p_type) AS name, CASE WHEN c_mktsegment IS NOT NULL THEN 'customers' WHEN s_name IS NOT NULL THEN 'suppliers' WHEN p_type IS NOT NULL THEN 'parts' END AS provider
FROM (SELECT DISTINCT o_custkey AS key FROM orders) k LEFT JOIN customer ON c_custkey = key AND key % 3 = 0 LEFT JOIN supplier ON s_suppkey = key LEFT JOIN part ON p_partkey = key AND key % 2 = 0""",
)
def kept_lookups(spark, d):
    """Half of the keys are asked for first; the second run asks for the rest, and what it returns is the whole."""
    own = lambda name, key, value: table(spark, d, name).select(F.col(key).alias("key"), F.col(value).alias("name"))
    providers = [
        ("customers", lambda k: own("customer", "c_custkey", "c_mktsegment").where("key % 3 = 0")),
        ("suppliers", lambda k: own("supplier", "s_suppkey", "s_name")),
        ("parts", lambda k: own("part", "p_partkey", "p_type").where("key % 2 = 0")),
    ]
    cache = stages.folder(spark, "lookups")
    wanted = table(spark, d, "orders").select(F.col("o_custkey").alias("key"))
    lookups.looked_up(wanted.where("key % 2 = 0"), cache, providers, "key", "name string")
    return lookups.looked_up(wanted, cache, providers, "key", "name string")[0]


@register(
    "page_places",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'City ' || (o_custkey % 50) WHEN o_orderkey % 4 < 3 THEN 'Port ' || chr(CAST(65 + o_custkey % 26 AS INTEGER)) END AS city,
CASE o_orderkey % 4 WHEN 1 THEN CAST(77000 + o_custkey % 100 AS VARCHAR) WHEN 3 THEN CAST(78000 + o_custkey % 100 AS VARCHAR) END AS zip FROM orders""",
)
def page_places(spark, d):
    """a page's place by its first mention, or by its text."""
    o = table(spark, d, "orders")
    form = F.col("o_orderkey") % 4
    town = F.concat(F.lit("1; port "), F.lower(F.char(F.lit(65) + F.col("o_custkey") % 26)))
    text = F.when(form == 1, F.concat(town, F.lit(", TX "), F.lit(77000) + F.col("o_custkey") % 100)).when(form == 2, F.concat(town, F.lit(", TX"))).when(form == 3, F.concat(F.lit("Zip code: "), F.lit(78000) + F.col("o_custkey") % 100)).otherwise("x, TX 70000")
    first = o.where(form == 0).select("o_orderkey", F.lit(2).alias("id"), F.concat(F.lit("City "), F.col("o_custkey") % 50).alias("city"), F.lit(None).cast("string").alias("zip"))
    mentions = first.unionByName(first.withColumn("id", F.lit(1)).withColumn("city", F.lit(None).cast("string"))).unionByName(first.withColumn("id", F.lit(3)).withColumn("city", F.lit("other")))
    return spatial.page_places(o.select("o_orderkey", text.alias("text")), mentions, ["o_orderkey"], "text", "id")


#: A customer's order names an organisation in one of eight ways, or something that is none.
_ORG_NAMES = """m AS (SELECT o_orderkey, o_custkey, CASE o_orderkey % 8 WHEN 0 THEN 'City of ' || n_name WHEN 1 THEN 'CITY OF ' || n_name WHEN 2 THEN 'The City of ' || n_name WHEN 3 THEN n_name || ' Department & Co' WHEN 4 THEN 'Total Budget' WHEN 5 THEN 'HUD' WHEN 6 THEN 'B-17-DM-48-0001' ELSE 'Label: ' || n_name END AS entity_text
FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT n_nationkey, translate(n_name, '0123456789_', 'abcdefghij ') AS n_name FROM nation) ON c_nationkey = n_nationkey)"""


def _org_names(spark, d):
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.translate("n_name", "0123456789_", "abcdefghij ").alias("n_name"))
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(nations), "c_nationkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    n = F.col("n_name")
    forms = (F.concat(F.lit("City of "), n), F.concat(F.lit("CITY OF "), n), F.concat(F.lit("The City of "), n), F.concat(n, F.lit(" Department & Co")), F.lit("Total Budget"), F.lit("HUD"), F.lit("B-17-DM-48-0001"), F.concat(F.lit("Label: "), n))
    return o.select("o_orderkey", "o_custkey", F.element_at(F.array(*forms), (F.col("o_orderkey") % 8 + 1).cast("int")).alias("entity_text"))


@register(
    "org_aliases",
    f"""WITH {_ORG_NAMES}, n AS (SELECT entity_text AS alias, count(*) AS n FROM m WHERE o_orderkey % 8 IN (0, 1, 2, 3, 5) GROUP BY 1 HAVING count(*) >= 2),
k AS (SELECT *, regexp_replace(trim(regexp_replace(lower(replace(alias, '&', ' and ')), '[^a-z0-9]+', ' ', 'g')), '^the ', '') AS key FROM n)
SELECT alias, key, CASE WHEN key = 'city of nation b' AND count(*) FILTER (alias = 'City of NATION b') OVER (PARTITION BY key) > 0 THEN 'City of NATION b' ELSE first_value(alias) OVER (PARTITION BY key ORDER BY n DESC, alias) END AS canonical, n FROM k""",
)
def org_aliases(spark, d):
    """Aliases of what may be an organisation; one seed is canonical whatever its count."""
    return resolve.org_aliases(_org_names(spark, d), seeds=("City of NATION b",))


@register(
    "org_edges",
    f"""WITH {_ORG_NAMES}, f AS (SELECT o_custkey, entity_text, min(o_orderkey) AS start FROM m WHERE o_orderkey % 8 IN (0, 1, 2, 3, 5) GROUP BY 1, 2),
r AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY start, entity_text) <= 5)
SELECT a.entity_text AS subject, b.entity_text AS object, count(*) AS weight FROM r a JOIN r b USING (o_custkey) WHERE a.entity_text < b.entity_text GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def org_edges(spark, d):
    """G1: organisations that share a customer, noise of forms left out before pairs are made; five of a customer at most."""
    m = resolve.organisations(_org_names(spark, d), candidates=False).withColumnRenamed("o_orderkey", "start")
    return resolve.edges(m, ["o_custkey"], "entity_text", 5, 2)
