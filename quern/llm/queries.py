"""The queries that apply each operator of this subpackage, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import chunk_store, click_dedup, decontaminate, license_scan, line_dedup, ngram_join, packing, spelling, substring_dedup, topk, toxicity, warc, wrapper


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents")).drop("set_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_decisions(table(spark, sf_dir, "documents"))
    return found.withColumn("removed", F.array_join("removed", ","))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats_removed(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(table(spark, sf_dir, "pages"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_store.stored(table(spark, sf_dir, "documents")).read_back()


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_texts(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(table(spark, sf_dir, "documents"))


def op12_expiring_click_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return click_dedup.windows(table(spark, sf_dir, "clicks"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_line_dedup,
        op3_substring_dedup,
        op4_warc,
        op5_benchmark_decontamination,
        op6_exact_top_k,
        op7_token_store,
        op8_toxicity,
        op9_html_extraction,
        op10_packing,
        op11_license_scan,
        op12_expiring_click_dedup,
        op13_spelling_variants,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SHINGLES = """CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END"""

_TEMPLATES = ", ".join("('{}', {}, '{}')".format(t.label, t.phrase, t.text.replace("'", "''")) for t in license_scan.TEMPLATES)
_CRC_TABLE = "(SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table)"


def _crc(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes, beside crc_table."""
    of = f"list_transform(range(CAST(octet_length(encode({text})) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {of}), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])))"


ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents),
s AS (SELECT doc_id, {_SHINGLES} AS s FROM d), x AS (SELECT doc_id, len(s) AS n, s FROM s),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(s)) AS rep, n, s FROM x WHERE n > 0),
t AS (SELECT rep, n, unnest(s) AS t FROM c WHERE doc_id = rep),
p AS (SELECT a.rep AS a, b.rep AS b FROM t a JOIN t b ON a.t = b.t AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p UNION SELECT rep, doc_id FROM c WHERE rep <> doc_id UNION SELECT doc_id, rep FROM c WHERE rep <> doc_id),
r(id, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT doc_id, n AS n_shingles, component_id FROM x JOIN (SELECT id AS doc_id, min(reach) AS component_id FROM r GROUP BY 1) USING (doc_id)""",
    "op2_line_dedup": rf"""WITH l AS (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
w AS (SELECT doc_id, line_no, list_filter(string_split_regex(lower(line), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM l),
s AS (SELECT doc_id, line_no, array_to_string(w, ' ') AS line, {_SHINGLES} AS s FROM w WHERE len(w) > 0),
c AS (SELECT line, min((doc_id, line_no)) AS first, any_value(s) AS s FROM s GROUP BY 1),
t AS (SELECT line, first, len(s) AS n, unnest(s) AS t FROM c),
m AS (SELECT DISTINCT b.line FROM (SELECT a.line AS a, b.line AS b FROM t a JOIN t b ON a.t = b.t AND a.first < b.first GROUP BY a.line, b.line, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))) p JOIN c b ON p.b = b.line),
g AS (SELECT doc_id, list_sort(list(CAST(line_no AS INTEGER))) AS removed FROM s JOIN c USING (line) WHERE (doc_id, line_no) <> first OR line IN (FROM m) GROUP BY 1)
SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(removed), 0) AS BIGINT) AS n_removed, coalesce(array_to_string(removed, ','), '') AS removed FROM documents LEFT JOIN g USING (doc_id)""",
    "op3_substring_dedup": f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d), h AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS t FROM x),
r AS (SELECT doc_id, i FROM h JOIN (SELECT t FROM h GROUP BY 1 HAVING count(*) > 1) USING (t)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM r), y AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
z AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS kept FROM y ANTI JOIN g USING (doc_id, k) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN z USING (doc_id)""",
    "op5_benchmark_decontamination": f"""WITH b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark), bl AS (SELECT item_id, w, least(13, len(w)) AS m FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS t FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM bl)),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
dw AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS t FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw))),
o AS (SELECT doc_id, i, m, item_id FROM dw JOIN bw USING (m, t)), k AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM o) GROUP BY 1),
n AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM o GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op6_exact_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT a.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.q, b.q) DESC, b.vec_id) AS INTEGER) AS rank, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 QUALIFY rank <= 5""",
    "op11_license_scan": f"""WITH t AS (SELECT label, phrase, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_ALNUM}) AS w, CASE WHEN phrase THEN 2 ELSE 3 END AS k FROM (VALUES {_TEMPLATES}) v(label, phrase, text)),
tg AS (SELECT label, phrase, len(w) AS size, k, tp, array_to_string(w[tp + 1:tp + k], ' ') AS gram FROM (SELECT *, unnest(range(0, len(w) - k + 1)) AS tp FROM t)),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
dg AS (SELECT doc_id, k, p, array_to_string(w[p + 1:p + k], ' ') AS gram FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS p FROM d, (VALUES (2), (3)) v(k) WHERE len(w) >= k)),
v AS (SELECT doc_id, label, phrase, size, k, p - tp AS diagonal, list(DISTINCT tp) AS ats, min(p) AS f, max(p + k) AS l FROM dg JOIN tg USING (k, gram) GROUP BY ALL),
g AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, label ORDER BY diagonal) AS span FROM (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, label ORDER BY diagonal) > CASE WHEN phrase THEN 0 ELSE 3 END THEN 1 ELSE 0 END AS cut FROM v)),
s AS (SELECT doc_id, label, phrase, size, min(f) AS f, max(l) AS l, len(list_distinct(flatten(list_transform(flatten(list(ats)), lambda a: range(a, a + k))))) / size AS share FROM g GROUP BY doc_id, label, phrase, size, k, span),
y AS (SELECT * FROM s WHERE CASE WHEN phrase THEN share = 1 ELSE share >= 0.8 AND l - f <= 1.25 * size + 2 END),
r AS (SELECT doc_id, count(*) FILTER (phrase) AS n_base, min(f) FILTER (phrase) AS first_word, max(f) FILTER (phrase) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM y GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN r USING (doc_id)""",
    "op12_expiring_click_dedup": f"""WITH RECURSIVE c AS (SELECT click_id, CAST(floor(epoch_us(arrived_at) / 3600000000) AS BIGINT) AS h0, unnest(range(0, click_id % 3 + 1)) AS j,
  concat(client_id, '|', kind, '|', CAST(floor(100 * value + 0.5) AS BIGINT), '|', epoch_us(ts), '|', props, '|') AS p FROM clicks WHERE click_id >= 0 AND arrived_at IS NOT NULL),
x AS (SELECT click_id, h0 + 6 * j * (c % 10) AS hour, c, sha256(p || (c % 3)) AS hash FROM (SELECT *, {_crc("(click_id || ':' || j)")} AS c FROM c, {_CRC_TABLE})),
l AS (SELECT *, hour + (c // 10) % 200 AS l FROM x), b AS (SELECT click_id, hour, hash, (l - lo) * 8 // (hi - lo + 1) AS b FROM l, (SELECT min(l) AS lo, max(l) AS hi FROM l)),
m AS (SELECT v.b, max(hour) AS m FROM range(0, 8) v(b) JOIN b ON b.b <= v.b GROUP BY 1),
k AS (SELECT b.*, row_number() OVER (PARTITION BY click_id ORDER BY b.b, hour, hash) AS rn, (SELECT coalesce(min(n.b), 7) FROM m n WHERE n.b >= b.b AND hour + 24 < n.m - 96) AS ends FROM b LEFT JOIN m ON m.b = b.b - 1 WHERE m.m IS NULL OR hour >= m.m - 96),
r(click_id, rn, o, s, ends) AS (SELECT click_id, rn, rn, hour, ends FROM k WHERE rn = 1 UNION ALL
  SELECT k.click_id, k.rn, CASE WHEN k.b <= r.ends AND hour <= s + 24 THEN o ELSE k.rn END, CASE WHEN k.b <= r.ends AND hour <= s + 24 THEN s ELSE hour END, CASE WHEN k.b <= r.ends AND hour <= s + 24 THEN r.ends ELSE k.ends END
  FROM r JOIN k ON k.click_id = r.click_id AND k.rn = r.rn + 1),
w AS (SELECT click_id, o, any_value(s) AS start_hour, any_value(ends) AS ends, count(*) - 1 AS n_repeats FROM r GROUP BY 1, 2),
n AS (SELECT r.click_id, r.o, count(*) AS n_conflicts, CAST(sum({_crc("k.hash")}) AS BIGINT) AS conflict_crc FROM r JOIN k USING (click_id, rn) JOIN k f ON f.click_id = r.click_id AND f.rn = r.o, {_CRC_TABLE} WHERE k.hash <> f.hash GROUP BY 1, 2)
SELECT w.click_id, start_hour, CAST(least(w.ends, lead(f.b) OVER (PARTITION BY w.click_id ORDER BY w.o)) AS BIGINT) AS closed_batch, n_repeats, coalesce(n_conflicts, 0) AS n_conflicts, coalesce(conflict_crc, 0) AS conflict_crc, f.hash
FROM w JOIN k f ON f.click_id = w.click_id AND f.rn = w.o LEFT JOIN n ON n.click_id = w.click_id AND n.o = w.o""",
    "op13_spelling_variants": f"""WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS n FROM r WHERE length(w) >= 7 GROUP BY 1, 2), h AS (SELECT w, n, {_crc("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)")} AS h FROM c, {_CRC_TABLE}),
e AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
k AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS x FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS other, b.n FROM k a JOIN k b ON a.x = b.x AND a.i = b.i AND a.word <> b.word UNION SELECT k.word, v.word, v.n FROM k JOIN v ON v.word = k.x UNION SELECT v.word, k.word, k.n FROM k JOIN v ON v.word = k.x),
f AS (SELECT word, count(*) AS n_near, max(n) AS most, arg_min(other, (-n, other)) AS best FROM p GROUP BY 1),
g AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * v.n THEN best END AS form, CASE WHEN most >= 10 * v.n THEN most END AS form_n FROM v LEFT JOIN f USING (word)),
z(word, root) AS (SELECT word, word FROM g UNION ALL SELECT z.word, g.form FROM z JOIN g ON g.word = z.root WHERE g.form IS NOT NULL)
SELECT word, form, root, g.n, n_near, form_n FROM g JOIN (SELECT z.word, z.root FROM z JOIN g ON g.word = z.root WHERE g.form IS NULL) USING (word)""",
}
