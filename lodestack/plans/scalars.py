"""Scalar functions on text, vectors, JSON and time, over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats, text, vectors
from ..operators import memory, segmentation, validation
from .inputs import ARMS, CHUNKS, PAIRED, REQUESTS, TURNS, arm, chunks, document_items, requests, table, turns
from .registry import query

CJK = r"\x{4e00}-\x{9fff}"


@query(
    "h01_inline_html",
    r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages)
SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS clean FROM a""",
)
def inline_html(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.without_inline_tags(F.col("html")).cast("binary")).alias("clean"))


# Tables made of the lines of each document: a header of two cells, and one row for each line.
TABLES = r"""t AS (SELECT doc_id, '<table><tr><th>no</th><th>' || lang || '</th></tr>' || string_agg('<tr class="r"><td>' || pos || '</td><td><b>' || content || '</b></td><td> </td></tr>', '' ORDER BY pos) || '</table>' AS html FROM chunks GROUP BY doc_id, lang)"""


def html_tables(spark, d):
    rows = F.concat(F.lit('<tr class="r"><td>'), F.col("pos").cast("string"), F.lit("</td><td><b>"), "content", F.lit("</b></td><td> </td></tr>"))
    c = chunks(spark, d).groupBy("doc_id", "lang").agg(F.array_sort(F.collect_list(F.struct("pos", rows.alias("r")))).alias("rows"))
    return c.select("doc_id", F.concat(F.lit("<table><tr><th>no</th><th>"), "lang", F.lit("</th></tr>"), F.array_join(F.transform("rows", lambda x: x["r"]), ""), F.lit("</table>")).alias("html"))


ROWS = r"""r AS (SELECT doc_id, list_transform(regexp_extract_all(html, '(?is)<tr[^>]*>(.*?)</tr>', 1), lambda r: array_to_string(list_filter(list_transform(regexp_extract_all(r, '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1), lambda c: trim(regexp_replace(regexp_replace(c, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))), lambda x: x <> ''), ' | ')) AS rows FROM t)"""


@query("h02_table_rows", f"WITH {CHUNKS}, {TABLES}, {ROWS} SELECT doc_id, len(rows) AS n_rows, md5(array_to_string(rows, chr(10))) AS body FROM r")
def table_rows(spark, d):
    rows = html_tables(spark, d).select("doc_id", text.table_rows(F.col("html")).alias("rows"))
    return rows.select("doc_id", F.size("rows").cast("bigint").alias("n_rows"), F.md5(F.array_join("rows", "\n").cast("binary")).alias("body"))


CELLS = "len(list_filter(string_split(coalesce(rows[{i}], ''), '|'), lambda x: trim(x) <> ''))"


@query("h03_header_rows", f"WITH {CHUNKS}, {TABLES}, {ROWS}, n AS (SELECT doc_id, len(rows) AS n, {CELLS.format(i=1)} AS one, {CELLS.format(i=2)} AS two FROM r) SELECT doc_id, one >= 2 AND NOT (n >= 2 AND two > 0 AND one < two / 2) AS header FROM n")
def header_rows(spark, d):
    return html_tables(spark, d).select("doc_id", text.has_header_row(text.table_rows(F.col("html"))).alias("header"))


GLUE = f"list_filter(regexp_extract_all(text, '[a-z]{{24,}}'), lambda t: regexp_matches(t[4:], '{text.GLUE_WORDS}'))"


@query("h04_glued_words", f"SELECT doc_id, len({GLUE}) AS n FROM (SELECT doc_id, replace(lower(text), ' ', '') AS text FROM documents) WHERE len({GLUE}) > 0")
def glued(spark, d):
    return table(spark, d, "documents").select("doc_id", text.glued_words(F.replace(F.lower("text"), F.lit(" "), F.lit(""))).cast("bigint").alias("n")).filter("n > 0")


@query("h04_deglued")
def deglued(spark, d):
    """Every third blank between lower-case words stays; the runs that come of it are taken apart by the documents' own words."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    costs = segmentation.word_costs(docs)
    glued_ = docs.withColumn("text", F.regexp_replace("text", "([a-z]{3,}) ([a-z]{3,}) ([a-z]{3,}) ", "$1$2$3 "))
    return segmentation.deglued(glued_, costs).select("doc_id", "split_runs", F.md5(F.col("text").cast("binary")).alias("text"))


NUMBERED = CHUNKS + ", numbered AS (SELECT chunk_id, doc_id, pos, CASE pos % 5 WHEN 0 THEN '1.2 ' WHEN 1 THEN '第3章 ' WHEN 2 THEN '① ' WHEN 3 THEN '2) ' ELSE '' END || CASE doc_id % 3 WHEN 0 THEN '设备' ELSE '' END || content AS content FROM chunks)"


def numbered(spark, d):
    k = F.col("pos") % 5
    head = F.when(k == 0, "1.2 ").when(k == 1, "第3章 ").when(k == 2, "① ").when(k == 3, "2) ").otherwise("")
    return chunks(spark, d).select("chunk_id", "doc_id", "pos", F.concat(head, F.when(F.col("doc_id") % 3 == 0, "设备").otherwise(""), "content").alias("content"))


W = r"[\x{4e00}-\x{9fff}\x{ac00}-\x{d7a3}]"


@query(
    "h07_numbered_headings",
    rf"""WITH {NUMBERED}, t AS (SELECT chunk_id, trim(content) AS t, trim(regexp_extract(trim(content), '^\d{{1,2}}(?:[．.]\d{{1,2}}){{0,3}}[\s．.、]+(\S.*)$', 1)) AS rest FROM numbered)
SELECT chunk_id FROM t WHERE length(t) BETWEEN 2 AND 40 AND NOT regexp_matches(t, '[。.!?！？]$') AND NOT regexp_matches(t, '[。！？…]|\s[.!?]\s') AND NOT regexp_matches(t, '\d{{1,2}}\s*[.、．].*\d{{1,2}}\s*[.、．]')
  AND (regexp_matches(t, '^第\s*[一二三四五六七八九十百千0-9]+\s*[章节条部分]') OR regexp_matches(t, '^[가나다라마바사아자차카타파하][．.、]\s*{W}') OR regexp_matches(t, '^[①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮]\s*{W}')
       OR (rest <> '' AND (regexp_matches(rest, '{W}') OR (len(regexp_split_to_array(rest, '\s+')) <= 4 AND regexp_matches(rest, '^\p{{Lu}}')))))""",
)
def numbered_headings(spark, d):
    return numbered(spark, d).filter(text.is_numbered_heading(F.col("content"))).select("chunk_id")


COMMON = "[" + ", ".join(f"'{x}'" for x in text.DEVICE_COMMON) + "]"
MIXED = "(regexp_matches(f, '^[A-Za-z]') AND regexp_matches(f, '[0-9]'))"
PLAIN = f"(NOT {MIXED} AND length(f) >= 3 AND NOT list_contains({COMMON}, upper(f)))"
CAPS = f"({PLAIN} AND regexp_matches(f, '[A-Z]') AND f = upper(f))"


@query(
    "h08_device_tokens",
    f"""WITH t AS (SELECT doc_id, regexp_extract_all(text || ' D4i Datacon ASML 4i the' || doc_id, '[0-9A-Za-z]+') AS r FROM documents),
l AS (SELECT doc_id, list_concat(list_transform(list_filter(r, lambda f: {MIXED} OR {CAPS}), lambda f: upper(f)), list_transform(list_filter(r, lambda f: {PLAIN} AND NOT {CAPS} AND regexp_matches(f, '^[A-Z]')), lambda f: upper(f))) AS l FROM t),
e AS (SELECT doc_id, unnest(l) AS tok, unnest(range(len(l))) AS i FROM l), g AS (SELECT doc_id, tok, min(i) AS i FROM e GROUP BY ALL), u AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 16)
SELECT doc_id, string_agg(tok, ',' ORDER BY i) AS tokens FROM u GROUP BY doc_id""",
)
def device_tokens(spark, d):
    said = F.concat("text", F.lit(" D4i Datacon ASML 4i the"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", F.array_join(text.device_tokens(said), ",").alias("tokens"))


@query(
    "h11_numbers",
    r"""WITH t AS (SELECT doc_id, regexp_extract_all(text || ' 4,000 1.2万 3千 5 12.0 ' || doc_id, '\d[\d,，]*(?:\.\d+)?\s*[万千]?') AS f FROM documents),
v AS (SELECT doc_id, list_filter(list_transform(f, lambda x: TRY_CAST(regexp_replace(regexp_extract(x, '^([\d,，.]+)', 1), '[,，]', '', 'g') AS DOUBLE) * CASE WHEN suffix(x, '万') THEN 10000 WHEN suffix(x, '千') THEN 1000 ELSE 1 END), lambda y: y >= 10) AS v FROM t)
SELECT doc_id, CAST(len(list_distinct(v)) AS BIGINT) AS n, round(list_max(v), 3) AS top FROM v""",
)
def numbers(spark, d):
    n = table(spark, d, "documents").select("doc_id", text.numbers(F.concat("text", F.lit(" 4,000 1.2万 3千 5 12.0 "), F.col("doc_id").cast("string"))).alias("n"))
    return n.select("doc_id", F.size("n").cast("bigint").alias("n"), F.round(F.array_max(F.transform("n", lambda x: x.cast("double"))), 3).alias("top"))


@query("h12_sentences", r"""WITH t AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^。!?;；\n]*[。!?;；\n]|[^。!?;；\n]+$'), lambda x: trim(regexp_replace(x, '^\s+|\s+$', '', 'g'))), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n, md5(regexp_replace(array_to_string(s, ''), '[\s，。、;；:：,\."''“”‘’「」『』【】\[\]()（）·—\-]', '', 'g')) AS k FROM t""")
def sentences(spark, d):
    s = table(spark, d, "documents").select("doc_id", text.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("bigint").alias("n"), F.md5(text.norm_key(F.array_join("s", "")).cast("binary")).alias("k"))


PUNCT = text.FINGERPRINT_PUNCTUATION.replace("'", "''").replace('\\"', '"')


@query("h13_fingerprints", f"WITH b AS (SELECT item_id, text, lead(text) OVER (ORDER BY item_id) AS answer FROM benchmark) SELECT item_id, sha1(regexp_replace(lower(trim(text)), '{PUNCT}', '', 'g')[1:300] || '|' || regexp_replace(lower(trim(coalesce(answer, ''))), '{PUNCT}', '', 'g')[1:300]) AS fp FROM b")
def fingerprints(spark, d):
    b = table(spark, d, "benchmark")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("answer"))
    return b.join(nxt, "item_id", "left").select("item_id", text.fingerprint(F.col("text"), F.col("answer")).alias("fp"))


STOP = "[" + ", ".join(f"'{x}'" for x in text.ANCHOR_STOP) + "]"


@query(
    "h14_anchor_share",
    rf"""WITH {PAIRED}, a AS (SELECT item_id, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z]{{3,}}|\d+(?:\.\d+)?'), lambda x: lower(x)), lambda y: NOT list_contains({STOP}, y)) AS a FROM benchmark)
SELECT doc_id, item_id, round(CASE WHEN len(a) > 0 THEN len(list_filter(a, lambda x: contains(lower(p.text), x))) / len(a) ELSE 0 END, 6) AS share FROM a JOIN paired p USING (item_id)""",
)
def anchor_share(spark, d):
    return document_items(spark, d).select("doc_id", "item_id", F.round(text.anchor_share(text.anchors(F.col("fact")), F.col("text")), 6).alias("share"))


@query(
    "h15_bigram_coverage",
    rf"""WITH {PAIRED}, n AS (SELECT p.doc_id, item_id, regexp_replace(lower(b.text), '[^a-z0-9{CJK}]+', '', 'g')[1:120] AS f, regexp_replace(lower(p.text), '[^a-z0-9{CJK}]+', '', 'g') AS c FROM benchmark b JOIN paired p USING (item_id)),
p AS (SELECT doc_id, item_id, f, c, list_distinct(list_transform(range(1, length(f)), lambda i: f[i:i+1])) AS g FROM n) SELECT doc_id, item_id, round(CASE WHEN length(f) < 6 THEN 0 ELSE len(list_filter(g, lambda x: contains(c, x))) / len(g) END, 6) AS cover FROM p""",
)
def bigram_coverage(spark, d):
    return document_items(spark, d).select("doc_id", "item_id", F.round(text.bigram_coverage(F.col("fact"), F.col("text")), 6).alias("cover"))


@query("h16_token_estimates", rf"WITH {TURNS} SELECT thread_id, pos, CAST(floor(len(regexp_extract_all(content || '设备手册', '[{CJK}]')) + len(list_filter(regexp_split_to_array(content || '设备手册', '\s+'), lambda x: x <> '')) * 1.3::DOUBLE) AS INT) + 4 AS tokens FROM turns")
def token_estimates(spark, d):
    return turns(spark, d).select("thread_id", "pos", (text.token_estimate(F.concat("content", F.lit("设备手册"))) + 4).alias("tokens"))


@query("h17_truncated", "SELECT doc_id, CASE WHEN length(text) > 800 THEN text[1:800] || '…[已截断]' ELSE text END AS t FROM documents")
def truncated(spark, d):
    return table(spark, d, "documents").select("doc_id", text.truncated(F.col("text"), 800).alias("t"))


@query(
    "h18_extractive_check",
    r"""WITH s AS (SELECT doc_id, text, [text[1:40], 'not in the text', text[50:90], text[1:40]] AS s FROM documents), n AS (SELECT doc_id, text, list_filter(s, lambda x: trim(x) <> '' AND contains(regexp_replace(text, '\s+', '', 'g'), regexp_replace(x, '\s+', '', 'g'))) AS k FROM s)
SELECT doc_id, CASE WHEN len(k) > 0 THEN array_to_string(CASE WHEN len(k) > 1 AND k[1] <> k[2] AND (len(k) < 3 OR k[3] = k[1]) THEN k[1:2] WHEN len(k) = 3 AND k[1] = k[2] THEN k[1:1] ELSE k[1:1] END, chr(10)) ELSE text[1:100] END AS kept FROM n""",
)
def extractive(spark, d):
    t = F.col("text")
    said = F.array(F.substring(t, 1, 40), F.lit("not in the text"), F.substring(t, 50, 41), F.substring(t, 1, 40))
    return table(spark, d, "documents").select("doc_id", memory.verbatim(said, t, 100).alias("kept"))


@query("h19_thread_users", f"WITH {TURNS} SELECT DISTINCT thread_id, split_part(thread_id, '|', 1) AS username, split_part(thread_id, '|', 1) || '|' || split_part(thread_id, '|', 2) AS key FROM turns")
def thread_users(spark, d):
    u = text.user_of_thread(F.col("thread_id"))
    return turns(spark, d).select("thread_id", u.alias("username"), text.thread_key(u, F.substring_index("thread_id", "|", -1)).alias("key")).distinct()


@query(
    "h20_tables_of_contents",
    r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN replace(text, chr(10), ' ' || doc_id || chr(10)) || ' 7' WHEN doc_id % 9 = 0 THEN text || ' .... 12' ELSE text END AS t FROM documents), l AS (SELECT doc_id, t, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda y: y <> '') AS l FROM t)
SELECT doc_id FROM l WHERE regexp_matches(t, '\.\.\.|．．|…') OR (len(l) >= 5 AND len(list_filter(l, lambda x: regexp_matches(x, '\d+\s*$'))) / len(l) >= 0.4)""",
)
def tocs(spark, d):
    t = F.when(F.col("doc_id") % 4 == 0, F.concat(F.replace("text", F.lit("\n"), F.concat(F.lit(" "), F.col("doc_id").cast("string"), F.lit("\n"))), F.lit(" 7"))).when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit(" .... 12"))).otherwise(F.col("text"))
    return table(spark, d, "documents").filter(text.looks_like_toc(t)).select("doc_id")


@query("i01_cosine", f"WITH {ARMS} SELECT query_id, round(avg(score), 5) AS mean, round(min(score), 5) AS low FROM dense GROUP BY query_id")
def cosine(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    a = arm(spark, d, "dense").select("query_id", "chunk_id")
    both = a.join(e, "chunk_id").join(e.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q")), "query_id")
    return both.withColumn("c", F.round(vectors.cosine(F.col("q"), F.col("embedding")), 6)).groupBy("query_id").agg(F.round(F.avg("c"), 5).alias("mean"), F.round(F.min("c"), 5).alias("low"))


@query("i02_normalized", "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first, round(list_sum(list_transform(e, lambda x: abs(x))) / sqrt(list_dot_product(e, e)), 5) AS total FROM v")
def normalized(spark, d):
    n = table(spark, d, "embeddings").select("vec_id", vectors.normalized(F.col("embedding")).alias("n"))
    return n.select("vec_id", F.round(F.get("n", F.lit(0)), 6).alias("first"), F.round(F.aggregate("n", F.lit(0.0), lambda s, x: s + F.abs(x)), 5).alias("total"))


@query("i04_percentile_linear", f"WITH {REQUESTS} SELECT tier, round(quantile_cont(latency_ms, 0.5), 4) AS p50, round(quantile_cont(latency_ms, 0.95), 4) AS p95 FROM requests GROUP BY tier")
def percentile_linear(spark, d):
    return requests(spark, d).groupBy("tier").agg(F.round(stats.linear(F.col("latency_ms"), 0.5), 4).alias("p50"), F.round(stats.linear(F.col("latency_ms"), 0.95), 4).alias("p95"))


@query(
    "i05_percentile_nearest",
    f"WITH {REQUESTS}, l AS (SELECT username, list_sort(list(latency_ms)) AS l FROM requests GROUP BY username) SELECT username, l[least(len(l), CAST(floor(len(l) * 0.95::DOUBLE) AS INT) + 1)] AS nearest, l[CAST(floor(len(l) * 0.95::DOUBLE) AS INT) + 1] AS floored, l[CASE WHEN floor(len(l) * 0.95::DOUBLE) - 1 < 0 THEN len(l) ELSE CAST(floor(len(l) * 0.95::DOUBLE) AS INT) END] AS ranked FROM l",
)
def percentile_nearest(spark, d):
    return stats.values_at(requests(spark, d), "latency_ms", {"nearest": stats.nearest_place, "floored": stats.floor_place, "ranked": stats.rank_place}, ["username"])


@query("i06_vector_literals", "SELECT vec_id, '[' || array_to_string(list_transform(embedding[1:3], lambda x: printf('%.6f', CAST(x AS DOUBLE))), ',') || ']' AS v FROM embeddings")
def literals(spark, d):
    return table(spark, d, "embeddings").select("vec_id", vectors.literal(F.slice("embedding", 1, 3)).alias("v"))


@query("i12_json_payload", """WITH p AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'noise ' || props || ' tail' WHEN 1 THEN props[1:4] ELSE props END AS raw FROM events) SELECT event_id, TRY_CAST(json_extract_string(CASE WHEN json_valid(regexp_extract(raw, '(?s)\\{.*\\}', 0)) THEN regexp_extract(raw, '(?s)\\{.*\\}', 0) END, '$.k') AS BIGINT) AS k FROM p""".replace("\\\\", "\\"))
def json_payload(spark, d):
    e = table(spark, d, "events")
    raw = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("noise "), "props", F.lit(" tail"))).when(F.col("event_id") % 5 == 1, F.substring("props", 1, 4)).otherwise(F.col("props"))
    return e.select("event_id", validation.payload(raw, "k bigint")["k"].alias("k"))


@query(
    "i13_argument_checks",
    r"""WITH a AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '3' WHEN 1 THEN '3.0' WHEN 2 THEN 'x' WHEN 3 THEN 'true' WHEN 4 THEN NULL ELSE '7.5' END AS k, event_type AS mode FROM events),
e AS (SELECT event_id, CASE WHEN regexp_full_match(k, '[+-]?\d+(\.0*)?') THEN CAST(CAST(k AS DOUBLE) AS BIGINT) END AS k, array_to_string(list_filter([CASE WHEN k IS NULL THEN 'k: missing' END, CASE WHEN k IS NOT NULL AND NOT regexp_full_match(k, '[+-]?\d+(\.0*)?') THEN 'k: not an integer' END,
 CASE WHEN mode NOT IN ('click', 'view', 'error') THEN 'mode: not allowed' END, CASE WHEN length(mode) > 6 THEN 'mode: too long' END], lambda x: x IS NOT NULL), '; ') AS errors FROM a) SELECT * FROM e""",
)
def argument_checks(spark, d):
    e = table(spark, d, "events")
    m = F.col("event_id") % 6
    k = F.when(m == 0, "3").when(m == 1, "3.0").when(m == 2, "x").when(m == 3, "true").when(m != 4, "7.5")
    rules = [validation.Rule("k", "integer", required=True), validation.Rule("mode", "string", allowed=["click", "view", "error"], longest=6)]
    checked = e.select("event_id", F.create_map(F.lit("k"), k, F.lit("mode"), F.col("event_type")).alias("args")).select("event_id", validation.coerced(F.col("args"), rules).alias("r"))
    return checked.select("event_id", "r.values.k", F.array_join("r.errors", "; ").alias("errors"))


@query("i14_stale_threads", f"WITH {REQUESTS} SELECT username, max(ts) AS last FROM requests GROUP BY username HAVING max(ts) < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 1 DAY")
def stale(spark, d):
    last = requests(spark, d).groupBy("username").agg(F.max("ts").alias("last"))
    return last.filter(F.col("last") < F.expr("timestamp '2024-01-30 00:00:00' - interval 1 day")).select("username", F.col("last").cast("timestamp_ntz").alias("last"))


@query(
    "i15_trace_documents",
    f"WITH {REQUESTS} SELECT username, count(*) AS steps, CAST(sum(latency_ms) AS BIGINT) AS elapsed_ms, CAST(sum(prompt + completion) AS BIGINT) AS tokens, string_agg(tool || ':' || latency_ms, ',' ORDER BY ts, event_id) AS trace FROM requests GROUP BY username",
)
def traces(spark, d):
    g = requests(spark, d).groupBy("username").agg(F.count("*").alias("steps"), F.sum("latency_ms").alias("elapsed_ms"), F.sum(F.col("prompt") + F.col("completion")).alias("tokens"), F.array_sort(F.collect_list(F.struct("ts", "event_id", "tool", "latency_ms"))).alias("t"))
    return g.select("username", "steps", "elapsed_ms", "tokens", F.array_join(F.transform("t", lambda x: F.concat_ws(":", x["tool"], x["latency_ms"].cast("string"))), ",").alias("trace"))


@query("i16_json_walk", "SELECT event_id, CAST(list_sum([CASE WHEN contains(props, '7') THEN 2 ELSE 0 END, 1]) AS BIGINT) AS n FROM events")
def json_walk(spark, d):
    nested = F.concat(F.lit('{"a": {"b": ["mark ", {"c": '), "props", F.lit('}]}, "d": "mark'), F.when(F.contains("props", F.lit("7")), ' mark7", "e": "mark').otherwise(""), F.lit('", "f": 1}'))
    found = validation.strings_with(nested, "mark")
    return table(spark, d, "events").select("event_id", (F.size(found) - 1 + F.size(F.filter(found, lambda x: x.contains("mark7")))).cast("bigint").alias("n"))


# What the strings held before their quotes and backslashes were left bare.
MENDED = r"""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE event_id % 4 WHEN 0 THEN 'say "hi" to ' || event_type WHEN 1 THEN 'C:\_' || event_type WHEN 2 THEN event_type ELSE '"' || event_type || '" done' END AS s FROM events""".replace("\\\\", "\\")


@query("i16_quotes_mended", MENDED)
def mended(spark, d):
    i, t = F.col("event_id") % 4, F.col("event_type")
    s = F.when(i == 0, F.concat(F.lit('say "hi" to '), t)).when(i == 1, F.concat(F.lit("C:\\_"), t)).when(i == 2, t).otherwise(F.concat(F.lit('"'), t, F.lit('" done')))
    raw = F.concat(F.regexp_replace("props", r"\}\s*$", ', "s": "'), s, F.lit('"}'))
    fixed = table(spark, d, "events").select("event_id", validation.quotes_mended(raw).alias("raw"))
    return fixed.select("event_id", validation.payload(F.col("raw"), "k bigint, s string").alias("p")).select("event_id", "p.k", "p.s")
