"""Registered queries over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import documents as docs_
from quern.operators import resolve, spatial, vectors
from quern.registry import register
from quern.sources.tables import table


def documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


@register("clean_text", r"SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x{00A0}]+', ' ', 'g')) AS cleaned, length(trim(regexp_replace(text, '[ \t\n\x{00A0}]+', ' ', 'g'))) AS n FROM documents")
def clean_text(spark, d):
    cleaned = T.clean_text(F.col("text"))
    return documents(spark, d).select("doc_id", cleaned.alias("cleaned"), F.length(cleaned).cast("bigint").alias("n"))


@register("amounts_read_back", "SELECT o_orderkey, round(o_totalprice, 2) AS amount, round(round(o_totalprice / 1e6, 3) * 1e6, 2) AS short_amount FROM orders")
def amounts_read_back(spark, d):
    o = table(spark, d, "orders")
    written = o.select("o_orderkey", F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("a"), F.concat(F.lit("$"), F.format_number(F.round(F.col("o_totalprice") / 1e6, 3), 3), F.lit(" million")).alias("b"))
    return written.select("o_orderkey", F.round(T.parse_usd(F.col("a")), 2).alias("amount"), F.round(T.parse_usd(F.col("b")), 2).alias("short_amount"))


@register(
    "report_blocks",
    """SELECT o_custkey AS document_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS block, 'ACT-' || o_orderkey AS activity_code,
CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Under Way' ELSE 'Cancelled' END AS status, round(o_totalprice, 2) AS total_budget FROM orders""",
)
def report_blocks(spark, d):
    """Report text is written, one document a customer, and its activity blocks are read back."""
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", "Under Way").otherwise("Cancelled")
    block = F.concat(F.lit("Grantee Activity Number: ACT-"), "o_orderkey", F.lit("\nActivity Status: "), status, F.lit("\nTotal Budget: $"), F.format_number("o_totalprice", 2), F.lit("\n"))
    reports = o.groupBy(F.col("o_custkey").alias("document_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", block.alias("b")))), lambda x: x["b"]), "").alias("text"))
    return activity_blocks(reports)


def activity_blocks(reports):
    """Blocks of a report's text, from one activity number to the next: code, status, budget."""
    parts = reports.select("document_id", F.posexplode(F.split("text", "(?=Grantee Activity Number:)")).alias("i", "b")).where(F.col("b").startswith("Grantee Activity Number:"))
    read = parts.select(
        "document_id", "i", T.extract(F.col("b"), "Grantee Activity Number:\\s*(\\S+)").alias("activity_code"),
        F.trim(T.extract(F.col("b"), "Activity Status:[ \\t]*([^\\n]+)")).alias("status"), T.parse_usd(T.extract(F.col("b"), "Total Budget:\\s*(\\$?[0-9.,]+)")).alias("total_budget"),
    )
    from pyspark.sql import Window

    return read.withColumn("block", F.row_number().over(Window.partitionBy("document_id").orderBy("i")).cast("bigint")).select("document_id", "block", "activity_code", "status", F.round("total_budget", 2).alias("total_budget"))


SPANS = """m AS (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]{5,}') AS f, string_split_regex(text, '[A-Z][a-z]{5,}') AS b FROM documents),
s AS (SELECT doc_id, unnest(f) AS entity_text, unnest(list_transform(range(1, len(f) + 1), lambda i: CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS BIGINT))) AS start FROM m)"""


@register("spans_with_offsets", f"WITH {SPANS} SELECT doc_id, entity_text, start, start + length(entity_text) AS \"end\" FROM s")
def spans_with_offsets(spark, d):
    found = docs_.capitalised(documents(spark, d))
    return found.select("doc_id", "entity_text", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


@register(
    "chunked_words",
    r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 200 THEN 1 ELSE CAST(ceil((len(w) - 200) / 160.0) AS BIGINT) + 1 END)) AS chunk FROM w)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, array_to_string(w[chunk * 160 + 1:chunk * 160 + 200], ' ') AS chunk_text FROM c""",
)
def chunked_words(spark, d):
    return vectors.chunks(documents(spark, d), 200, 40)


@register("good_chunks", "SELECT doc_id, lang FROM documents WHERE length(text) >= 200 AND length(regexp_replace(text, '[^0-9]', '', 'g'))::DOUBLE / nullif(length(text), 0) <= 0.02 AND NOT contains(lower(text), 'licensed under')")
def good_chunks(spark, d):
    return docs_.good_chunks(documents(spark, d), 200, 0.02, ("Licensed under",)).select("doc_id", "lang")


@register(
    "sentence_counts",
    r"SELECT doc_id, CAST(len(list_filter(string_split_regex(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, E' \t\n\r') <> '')) AS BIGINT) AS sentences FROM documents",
)
def sentence_counts(spark, d):
    return documents(spark, d).select("doc_id", T.sentence_count(F.col("text")).cast("bigint").alias("sentences"))


LINES = "l AS (SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS line_no, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))"


@register("context_snippets", f"WITH {LINES}, w AS (SELECT doc_id, line_no, line, array_to_string(list(line) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), ' ') AS snippet FROM l) SELECT doc_id, line_no, snippet FROM w WHERE regexp_matches(line, '[0-9]')")
def context_snippets(spark, d):
    return docs_.snippets(documents(spark, d), "[0-9]", 1)


@register("joined_pages", f"WITH {LINES} SELECT doc_id, string_agg(line, chr(10) || chr(10) || '--- PAGE BREAK ---' || chr(10) || chr(10) ORDER BY line_no) AS line FROM l WHERE line <> '' GROUP BY 1")
def joined_pages(spark, d):
    return docs_.page_text(docs_.lines(documents(spark, d)), "doc_id", "line_no", "line")


SECTIONS = rf"""WITH {LINES}, t AS (SELECT doc_id, line_no, trim(line, ' ') AS line FROM l),
x AS (SELECT *, coalesce(lag(line = '') OVER (PARTITION BY doc_id ORDER BY line_no), TRUE) AS after_blank,
  length(regexp_replace(line, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(line, '[^A-Z]', '', 'g')) AS capitals,
  list_filter(string_split_regex(line, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS tokens FROM t),
y AS (SELECT *, CASE WHEN length(line) <= 90 AND length(line) > 0 AND NOT regexp_matches(line, '\$[0-9]{{2}}') THEN
  CASE WHEN regexp_matches(line, '^[A-Za-z][A-Za-z /&-]{{2,60}}:$') THEN 'colon' WHEN letters >= 4 AND capitals >= 0.9 * letters THEN 'all_caps'
  WHEN len(tokens) >= 2 AND len(list_filter(tokens, lambda w: regexp_matches(w, '^[A-Z]'))) >= 0.9 * len(tokens) AND NOT regexp_matches(line, '[.!?,;]$') THEN 'title' END END AS method FROM x),
z AS (SELECT *, method IS NOT NULL AND (after_blank OR method = 'colon') AS is_heading FROM y),
g AS (SELECT *, CAST(sum(is_heading::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS section_index FROM z)
SELECT doc_id, section_index, CASE WHEN arg_min(is_heading, line_no) THEN arg_min(line, line_no) ELSE 'Document' END AS heading,
  CASE WHEN arg_min(is_heading, line_no) THEN arg_min(method, line_no) ELSE 'implicit' END AS method, min(line_no) AS start_line, max(line_no) AS end_line,
  count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM g GROUP BY 1, 2"""


@register("document_sections", SECTIONS)
def document_sections(spark, d):
    return docs_.sections(documents(spark, d))


@register("section_summary", f"SELECT method, count(*) AS sections, count(DISTINCT doc_id) AS documents FROM ({SECTIONS}) GROUP BY 1")
def section_summary(spark, d):
    return document_sections(spark, d).groupBy("method").agg(F.count(F.lit(1)).cast("bigint").alias("sections"), F.count_distinct("doc_id").cast("bigint").alias("documents"))


@register("frequent_lines", f"WITH {LINES} SELECT line, count(*) AS n FROM l WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(*) >= 3")
def frequent_lines(spark, d):
    return docs_.lines(documents(spark, d)).where(F.trim("line") != "").groupBy("line").agg(F.count(F.lit(1)).cast("bigint").alias("n")).where("n >= 3")


@register("entity_counts", f"WITH {SPANS} SELECT lang, count(*) AS mentions, count(DISTINCT entity_text) AS entities FROM s JOIN documents USING (doc_id) GROUP BY 1")
def entity_counts(spark, d):
    found = docs_.names(documents(spark, d)).join(documents(spark, d).select("doc_id", "lang"), "doc_id")
    return found.groupBy("lang").agg(F.count(F.lit(1)).cast("bigint").alias("mentions"), F.count_distinct("entity_text").cast("bigint").alias("entities"))


@register("top_entities", f"WITH {SPANS} SELECT entity_text, count(*) AS n FROM s GROUP BY 1 ORDER BY n DESC, entity_text LIMIT 20")
def top_entities(spark, d):
    return docs_.names(documents(spark, d)).groupBy("entity_text").agg(F.count(F.lit(1)).cast("bigint").alias("n")).orderBy(F.desc("n"), "entity_text").limit(20)


@register("keyword_pages", "SELECT k AS keyword, count(*) AS documents FROM documents, (SELECT unnest(['license', 'Copyright', 'trash', 'the']) AS k) WHERE contains(lower(text), lower(k)) GROUP BY 1")
def keyword_pages(spark, d):
    return docs_.keyword_hits(documents(spark, d), ["license", "Copyright", "trash", "the"])


@register("normal_keys", r"SELECT DISTINCT n_name AS name, trim(regexp_replace(trim(regexp_replace(lower(replace('The ' || n_name || ' & Co.', '&', ' and ')), '[^a-z0-9]+', ' ', 'g')), '^the ', '')) AS key FROM nation")
def normal_keys(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("name"), T.normalize_key(F.concat(F.lit("The "), "n_name", F.lit(" & Co."))).alias("key")).distinct()


ALIASES = rf"""WITH {SPANS}, n AS (SELECT entity_text, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT *, trim(regexp_replace(trim(regexp_replace(lower(replace(entity_text, '&', ' and ')), '[^a-z0-9]+', ' ', 'g')), '^the ', '')) AS key FROM n)
SELECT entity_text AS alias, key, first_value(entity_text) OVER (PARTITION BY key ORDER BY n DESC, entity_text) AS canonical, n FROM k WHERE key <> ''"""


@register("alias_groups", ALIASES)
def alias_groups(spark, d):
    return resolve.aliases(docs_.names(documents(spark, d)))


@register("frequent_mentions", f"WITH {SPANS} SELECT doc_id, entity_text, start FROM s WHERE entity_text IN (SELECT entity_text FROM s GROUP BY 1 HAVING count(*) >= 4)")
def frequent_mentions(spark, d):
    return resolve.frequent(docs_.capitalised(documents(spark, d)), "entity_text", 4).select("doc_id", "entity_text", F.col("start").cast("bigint").alias("start"))


EDGES = f"""WITH {SPANS}, f AS (SELECT doc_id, entity_text, min(start) AS start FROM s GROUP BY 1, 2),
r AS (SELECT doc_id, entity_text FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY start, entity_text) <= 5)
SELECT a.entity_text AS subject, b.entity_text AS object, count(*) AS weight FROM r a JOIN r b USING (doc_id) WHERE a.entity_text < b.entity_text GROUP BY 1, 2 HAVING count(*) >= 2"""


@register("relation_edges", EDGES)
def relation_edges(spark, d):
    return resolve.edges(docs_.names(documents(spark, d)), ["doc_id"], "entity_text", 5, 2)


SENTENCE_EDGES = r"""WITH t AS (SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents),
u AS (SELECT doc_id, generate_subscripts(p, 1) AS sentence, unnest(list_transform(p, lambda x: regexp_extract_all(x, '[A-Z][a-z]{5,}'))) AS f FROM t),
m AS (SELECT doc_id, sentence, unnest(f) AS entity_text, generate_subscripts(f, 1) AS k FROM u), f AS (SELECT doc_id, sentence, entity_text, min(k) AS k FROM m GROUP BY 1, 2, 3),
r AS (SELECT doc_id, sentence, entity_text FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, sentence ORDER BY k) <= 5)
SELECT a.entity_text AS subject, b.entity_text AS object, count(*) AS weight FROM r a JOIN r b USING (doc_id, sentence) WHERE a.entity_text < b.entity_text GROUP BY 1, 2"""


@register("relation_edges_by_sentence", SENTENCE_EDGES)
def relation_edges_by_sentence(spark, d):
    """The edges of W14 and G1: the first five names of each sentence are paired, whole documents through. Of any weight."""
    return resolve.edges(docs_.in_sentences(documents(spark, d)), ["doc_id", "sentence"], "entity_text", 5, 1)


@register("relation_evidence", f"WITH {SPANS} SELECT entity_text, doc_id, start, row_number() OVER (PARTITION BY entity_text ORDER BY doc_id, start) AS rank FROM s QUALIFY rank <= 2")
def relation_evidence(spark, d):
    return resolve.evidence(docs_.capitalised(documents(spark, d)), ["entity_text"], ["doc_id", "start"]).select("entity_text", "doc_id", F.col("start").cast("bigint").alias("start"), "rank")


MONEY = """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Total budget of $' WHEN 1 THEN 'Funds drawdown were $' WHEN 2 THEN 'They spent $' WHEN 3 THEN 'It obligated $' ELSE 'A sum of $' END AS lead, o_totalprice FROM orders),
c AS (SELECT o_orderkey, round(o_totalprice, 2) AS amount, CASE o_orderkey % 5 WHEN 0 THEN 'budget' WHEN 1 THEN 'drawdown' WHEN 2 THEN 'expended' WHEN 3 THEN 'obligated' ELSE 'unknown' END AS label,
  CASE o_orderkey % 5 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.9::DOUBLE WHEN 4 THEN 0.1::DOUBLE ELSE 0.75::DOUBLE END AS confidence FROM t)
"""


@register("money_context", MONEY + "SELECT o_orderkey, amount, label, confidence FROM c")
def money_context(spark, d):
    """Sentences with an amount are written, then amount, label and confidence are read from them."""
    leads = F.array(*map(F.lit, ("Total budget of $", "Funds drawdown were $", "They spent $", "It obligated $", "A sum of $")))
    text = F.concat(F.element_at(leads, (F.col("o_orderkey") % 5 + 1).cast("int")), F.format_number("o_totalprice", 2), F.lit(" there."))
    found = table(spark, d, "orders").select("o_orderkey", text.alias("sentence")).select("o_orderkey", "sentence", F.inline(T.spans(F.col("sentence"), T.ENTITY_PATTERNS["MONEY"])))
    context = T.money_context(F.col("sentence"), F.col("start"), F.col("end"))
    return found.select("o_orderkey", F.round(T.parse_usd(F.col("text")), 2).alias("amount"), context["label"].alias("label"), context["confidence"].alias("confidence"))


@register("money_by_context", MONEY + "SELECT label, count(*) AS mentions, round(sum(coalesce(amount, 0)), 2) AS total, max(amount) AS largest FROM c GROUP BY 1")
def money_by_context(spark, d):
    return money_context(spark, d).groupBy("label").agg(F.count(F.lit(1)).cast("bigint").alias("mentions"), F.round(F.sum(F.coalesce("amount", F.lit(0.0))), 2).alias("total"), F.max("amount").alias("largest"))


@register("spans_in_windows", f"WITH {SPANS} SELECT doc_id, CAST(start // 100 AS BIGINT) AS w, count(*) AS n FROM s WHERE start // 100 = (start + length(entity_text) - 1) // 100 GROUP BY 1, 2")
def spans_in_windows(spark, d):
    own = documents(spark, d)
    windows = own.select("doc_id", F.explode(F.sequence(F.lit(0), F.expr("length(text) div 100"))).alias("w")).select("doc_id", "w", (F.col("w") * 100).alias("w_start"), (F.col("w") * 100 + 100).alias("w_end"))
    return resolve.inside(docs_.capitalised(own), windows, "doc_id").groupBy("doc_id", F.col("w").cast("bigint").alias("w")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@register(
    "merged_spans",
    f"""WITH {SPANS}, p AS (SELECT doc_id, start - 10 AS start, start + 10 AS "end" FROM s),
f AS (SELECT *, (start > coalesce(max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1))::INT AS f FROM p),
g AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM f) SELECT doc_id, min(start) AS start, max("end") AS "end" FROM g GROUP BY doc_id, g""",
)
def merged_spans(spark, d):
    around = docs_.capitalised(documents(spark, d)).select("doc_id", (F.col("start") - 10).cast("bigint").alias("start"), (F.col("start") + 10).cast("bigint").alias("end"))
    return spatial.merged_spans(around, "doc_id")


@register("evaluation", "WITH g AS (SELECT doc_id FROM labels WHERE toxic = 1), p AS (SELECT doc_id FROM documents WHERE contains(lower(text), 'idiot') OR contains(lower(text), 'trash')), c AS (SELECT (SELECT count(*) FROM g WHERE doc_id IN (FROM p)) AS tp, (SELECT count(*) FROM p WHERE doc_id NOT IN (FROM g)) AS fp, (SELECT count(*) FROM g WHERE doc_id NOT IN (FROM p)) AS fn) SELECT tp, fp, fn, coalesce(round(tp::DOUBLE / nullif(tp + fp, 0), 6), 0) AS precision, coalesce(round(tp::DOUBLE / nullif(tp + fn, 0), 6), 0) AS recall, coalesce(round(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 6), 0) AS f1 FROM c")
def evaluation(spark, d):
    low = F.lower(F.col("text"))
    predicted = documents(spark, d).where(low.contains("idiot") | low.contains("trash"))
    return resolve.scores(table(spark, d, "labels").where("toxic = 1"), predicted, ["doc_id"])


@register("page_links", "SELECT page_id, regexp_replace(t, '[?#].*$', '') AS target FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS t FROM pages) WHERE regexp_replace(t, '[?#].*$', '') <> ''")
def page_links(spark, d):
    return docs_.links(table(spark, d, "pages"))


@register("substring_matches", "SELECT p_partkey, n_name FROM part, (SELECT DISTINCT substr(p_type, 1, 4) AS n_name FROM part) WHERE contains(lower(p_type), lower(n_name))")
def substring_matches(spark, d):
    part = table(spark, d, "part")
    patterns = part.select(F.substring("p_type", 1, 4).alias("n_name")).distinct()
    return docs_.substring_join(part, patterns, "p_type", "n_name").select("p_partkey", "n_name")


@register("term_weights", "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents), f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), g AS (SELECT term, count(*) AS df FROM f GROUP BY 1), w AS (SELECT doc_id, term, round(tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1.0), 6) AS tfidf FROM f JOIN g USING (term)) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, term) AS rank, term, tfidf FROM w QUALIFY rank <= 3")
def term_weights(spark, d):
    return vectors.top_terms(vectors.term_weights(documents(spark, d)), 3)


COSINE = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@register("nearest_vectors", f"SELECT a.vec_id, round({COSINE}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 7) b ORDER BY score DESC, vec_id LIMIT 10")
def nearest_vectors(spark, d):
    return vectors.nearest_to_row(table(spark, d, "embeddings"), 7, 10)


@register("best_seeds", f"SELECT vec_id, max(score) AS score, arg_min(seed, (-score, seed)) AS seed FROM (SELECT a.vec_id, b.vec_id AS seed, round({COSINE}, 6) AS score FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id < 3) b) GROUP BY 1 HAVING max(score) >= 0.1 ORDER BY score DESC, vec_id LIMIT 50")
def best_seeds(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.best_seed(e, e.where("vec_id < 3").select(F.col("vec_id").alias("seed"), "embedding"), 0.1, 50)


@register("vector_clusters")
def vector_clusters(spark, d):
    return vectors.clusters(table(spark, d, "embeddings"), 8)


@register("vector_groups")
def vector_groups(spark, d):
    """All rows, topic by topic; inside a topic the grouping is sequential by nature."""
    return vectors.greedy_groups(table(spark, d, "embeddings").withColumn("score", F.col("label").cast("double")), 0.3)
