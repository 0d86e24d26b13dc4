"""Lookups as joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import citations, containment, conversation, glossary, ranking, terms
from .inputs import ARMS, CHUNKS, TURNS, arm, chunks, table, turns
from .registry import query


@query(
    "c01_sibling_rows",
    f"""WITH {CHUNKS}, n AS (SELECT source_stem, heading_path, chunk_id AS other, chunk_index AS place, content[1:120] AS text FROM chunks QUALIFY row_number() OVER (PARTITION BY source_stem, heading_path ORDER BY chunk_index) <= 8),
p AS (SELECT c.chunk_id, n.place, n.text FROM chunks c JOIN n USING (source_stem, heading_path) WHERE length(c.content) <= 200 AND n.other <> c.chunk_id QUALIFY row_number() OVER (PARTITION BY c.chunk_id ORDER BY n.place) <= 2)
SELECT chunk_id, string_agg(text, chr(10) ORDER BY place) AS context FROM p GROUP BY chunk_id""",
)
def siblings(spark, d):
    return ranking.with_siblings(chunks(spark, d))


@query("c02_neighbours", f"WITH {CHUNKS} SELECT c.chunk_id, c.content || coalesce(chr(10) || n.content[1:500], '') AS content FROM chunks c LEFT JOIN chunks n ON n.source_stem = c.source_stem AND n.chunk_index = c.chunk_index + 1")
def neighbours(spark, d):
    n = ranking.with_neighbour(chunks(spark, d))
    return n.select("chunk_id", F.concat("content", F.coalesce(F.concat(F.lit("\n"), "next_content"), F.lit(""))).alias("content"))


@query("c03_scope_expansion", f"WITH {CHUNKS}, r AS (SELECT DISTINCT regexp_replace(source_stem, '_p\\d+[_-]\\d*$', '') AS base, source_stem FROM chunks), q AS (SELECT item_id AS query_id, unnest(string_split('src' || (item_id % 25) || '||src' || (item_id % 7), '||')) AS base FROM benchmark) SELECT query_id, count(DISTINCT r.source_stem) AS variants, min(r.source_stem) AS first FROM q LEFT JOIN r USING (base) GROUP BY query_id")
def scope_expansion(spark, d):
    r = chunks(spark, d).select(text.scope_stem(F.col("source_stem")).alias("base"), "source_stem").distinct()
    i = F.col("item_id")
    q = table(spark, d, "benchmark").select(i.alias("query_id"), F.explode(F.split(F.concat(F.lit("src"), (i % 25).cast("string"), F.lit("||src"), (i % 7).cast("string")), r"\|\|")).alias("base"))
    return q.join(r, "base", "left").groupBy("query_id").agg(F.count_distinct("source_stem").alias("variants"), F.min("source_stem").alias("first"))


@query("c04_parent_text", f"WITH {CHUNKS} SELECT i.chunk_id, p.content AS parent FROM chunks i LEFT JOIN chunks p ON p.source_stem = i.source_stem AND p.chunk_index = i.chunk_index - 2 WHERE i.content_type = 'portrait'")
def parents(spark, d):
    c = chunks(spark, d)
    p = c.select("source_stem", (F.col("chunk_index") + 2).alias("chunk_index"), F.col("content").alias("parent"))
    return c.filter("content_type = 'portrait'").join(p, ["source_stem", "chunk_index"], "left").select("chunk_id", "parent")


@query("c05_metadata", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(CAST(l.toxic AS VARCHAR), 'unknown') AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def metadata(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce(F.col("toxic").cast("string"), F.lit("unknown")).alias("toxic"))


@query("c06_overrides", "WITH f AS (SELECT event_id, value * 2 AS value FROM events WHERE event_id % 4 = 0 AND event_type <> 'error') SELECT event_type, count(f.event_id) AS replaced, count(*) - count(f.event_id) AS kept, round(sum(coalesce(f.value, e.value)), 2) AS total FROM events e LEFT JOIN f USING (event_id) GROUP BY event_type")
def overrides(spark, d):
    e = table(spark, d, "events")
    fixed = e.filter("event_id % 4 = 0 and event_type <> 'error'").select("event_id", (F.col("value") * 2).alias("fixed"))
    return e.join(fixed, "event_id", "left").groupBy("event_type").agg(F.count("fixed").alias("replaced"), (F.count("*") - F.count("fixed")).alias("kept"), F.round(F.sum(F.coalesce("fixed", "value")), 2).alias("total"))


@query("c07_hydrated", f"WITH {ARMS} SELECT query_id, chunk_id, md5(coalesce(d.text, 'snippet ' || chunk_id)) AS body FROM dense LEFT JOIN (SELECT * FROM documents WHERE doc_id % 3 <> 0) d ON d.doc_id = chunk_id WHERE rank <= 10")
def hydrated(spark, d):
    full = table(spark, d, "documents").filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("chunk_id"), "text")
    body = F.coalesce("text", F.concat(F.lit("snippet "), F.col("chunk_id").cast("string")))
    return arm(spark, d, "dense").filter("rank <= 10").join(full, "chunk_id", "left").select("query_id", "chunk_id", F.md5(body.cast("binary")).alias("body"))


@query("c08_basename_index", "WITH k AS (SELECT 'd' || (doc_id % 300) || '.jpg' AS name, 'kept/' || source || '/d' || (doc_id % 300) || '.jpg' AS key, doc_id FROM documents), i AS (SELECT name, arg_max(key, doc_id) AS key FROM k GROUP BY name) SELECT p_partkey, coalesce(i.key, 'images/d' || p_partkey || '.jpg') AS key FROM part LEFT JOIN i ON i.name = 'd' || p_partkey || '.jpg'")
def basenames(spark, d):
    name = F.concat(F.lit("d"), (F.col("doc_id") % 300).cast("string"), F.lit(".jpg"))
    keys = table(spark, d, "documents").select(F.concat(F.lit("kept/"), "source", F.lit("/"), name).alias("key"), "doc_id")
    index = keys.groupBy(F.element_at(F.split("key", "/"), -1).alias("name")).agg(F.max_by("key", "doc_id").alias("key"))
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("images/d"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("path"))
    return p.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(index, "name", "left").select("p_partkey", F.coalesce("key", "path").alias("key"))


@query("c09_not_done", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def not_done(spark, d):
    done = table(spark, d, "lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("c10_same_content", "SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS kept FROM documents QUALIFY count(*) OVER (PARTITION BY md5(text)) > 1")
def same_content(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("m"))
    groups = t.groupBy("m").agg(F.min("doc_id").alias("kept"), F.count("*").alias("n")).filter("n > 1")
    return t.join(groups, "m").select("doc_id", "kept")


NORM = r"regexp_replace(lower(content), '[^a-z0-9]+', '', 'g')"


@query("c11_contained_pairs", f"WITH {CHUNKS}, n AS (SELECT DISTINCT doc_id, pos, source_stem, {NORM} AS k FROM chunks WHERE length({NORM}) > 8) SELECT a.doc_id, a.pos AS one, b.pos AS two FROM n a JOIN n b ON a.source_stem = b.source_stem AND a.pos < b.pos AND (contains(a.k, b.k) OR contains(b.k, a.k))")
def contained(spark, d):
    # Pairs are within one document, whose lines are few.
    n = chunks(spark, d).select("doc_id", "pos", "source_stem", F.regexp_replace(F.lower("content"), "[^a-z0-9]+", "").alias("k")).filter("length(k) > 8")
    b = n.select("source_stem", F.col("pos").alias("two"), F.col("k").alias("k2"))
    return n.withColumnRenamed("pos", "one").join(b, "source_stem").filter((F.col("one") < F.col("two")) & (F.contains("k", F.col("k2")) | F.contains("k2", F.col("k")))).select("doc_id", "one", "two")


@query(
    "c11_contained_lines",
    f"""WITH {CHUNKS}, k AS (SELECT DISTINCT source, {NORM} AS k FROM chunks WHERE source IS NOT NULL AND length({NORM}) > 8)
SELECT a.source, md5(a.k) AS inner_line, md5(b.k) AS outer_line FROM k a JOIN k b ON a.source = b.source AND length(a.k) < length(b.k) AND contains(b.k, a.k)""",
)
def contained_lines(spark, d):
    """All distinct lines of a source."""
    k = chunks(spark, d).filter("source is not null").select("source", F.regexp_replace(F.lower("content"), "[^a-z0-9]+", "").alias("k")).filter("length(k) > 8").distinct()
    lines = k.select(F.col("source").alias("grp"), F.md5(F.col("k").cast("binary")).alias("id"), F.col("k").alias("text"))
    return containment.contained(lines).select(F.col("grp").alias("source"), F.col("inner").alias("inner_line"), F.col("outer").alias("outer_line"))


_PLAIN = lambda c: f"regexp_replace(lower({c}), '{citations.NOISE}', '', 'g')"
_SHARES = lambda size: f"length(n) >= {size} AND len(list_filter(range(1, length(n) - {size} + 2), lambda i: contains(s, n[i:i + {size} - 1]))) > 0"


@query(
    "c12_cited_sources",
    f"""WITH a AS (SELECT doc_id, source, coalesce(text, '') || ' [manual ' || source || ' p12] [图 3]' || CASE doc_id % 2 WHEN 0 THEN ' https://kb.example/' || source || '/a' ELSE '' END AS answer FROM documents),
b AS (SELECT DISTINCT source, CASE doc_id % 4 WHEN 3 THEN 'https://kb.example/' || source || '/' END AS url, CASE WHEN doc_id % 4 < 3 THEN ['Manual ' || source || ' edition ', source || ' by the manual ', 'Guide ' || source || ' '][doc_id % 4 + 1] || (doc_id % 3) ELSE '' END AS stem FROM documents WHERE source IS NOT NULL),
m AS (SELECT doc_id, answer, list_filter(list_transform(list_filter(regexp_extract_all(answer, '{citations.BRACKET}', 1), lambda x: NOT regexp_matches(x, '{citations.FIGURE}')), lambda x: {_PLAIN(f"regexp_replace(x, '{citations.PAGE}', '')")}), lambda y: length(y) >= 4) AS names FROM a),
p AS (SELECT a.doc_id, b.stem, b.url, m.answer, m.names, {_PLAIN('b.stem')} AS s FROM a JOIN b USING (source) JOIN m USING (doc_id)),
o AS (SELECT doc_id, stem, url, s, unnest(names) AS n FROM p),
h AS (SELECT DISTINCT doc_id, stem, url FROM o WHERE s <> '' AND (contains(n, s) OR contains(s, n) OR ({_SHARES(f"greatest({citations.LONG}, CAST(ceil(length(n) / 2) AS INT))")})
  OR ({_SHARES(citations.SHORT)} AND len(list_filter(list_distinct(string_split(n, '')), lambda c: contains(s, c))) / len(list_distinct(string_split(n, ''))) >= {citations.COVER})))
SELECT p.doc_id, p.stem, p.url, CASE WHEN p.url IS NOT NULL THEN contains(answer, rtrim(p.url, '/')) ELSE h.doc_id IS NOT NULL END AS cited FROM p LEFT JOIN h ON p.doc_id = h.doc_id AND p.stem = h.stem AND p.url IS NOT DISTINCT FROM h.url""",
)
def cited(spark, d):
    docs, i, src = table(spark, d, "documents"), F.col("doc_id"), F.col("source")
    web = F.concat(F.lit(" https://kb.example/"), src, F.lit("/a"))
    answers = docs.select("doc_id", "source", F.concat(F.coalesce("text", F.lit("")), F.lit(" [manual "), src, F.lit(" p12] [图 3]"), F.when(i % 2 == 0, web).otherwise("")).alias("answer"))
    names = F.array(F.concat(F.lit("Manual "), src, F.lit(" edition ")), F.concat(src, F.lit(" by the manual ")), F.concat(F.lit("Guide "), src, F.lit(" ")))
    stem = F.when(i % 4 < 3, F.concat(F.get(names, (i % 4).cast("int")), (i % 3).cast("string"))).otherwise("")
    sources = docs.filter("source is not null").select("source", F.when(i % 4 == 3, F.concat(F.lit("https://kb.example/"), src, F.lit("/"))).alias("url"), stem.alias("stem")).distinct()
    near = answers.select("doc_id", "source", citations.mentions(F.col("answer")).alias("found")).join(sources, "source")
    return near.select("doc_id", "stem", "url", citations.cited_among(F.col("found"), F.col("stem"), F.col("url")).alias("cited"))


def _terms(spark, d, key, name):
    p = table(spark, d, "part")
    return p.groupBy(F.lower(key).alias("en")).agg(F.count("*").alias("tf"), F.array_sort(F.collect_set(name)).alias("zh"))


GLOSSARY = "o AS (SELECT lower(p_name) AS en, count(*) AS tf, list_sort(list_distinct(list(p_type))) AS zh FROM part GROUP BY lower(p_name)), n AS (SELECT lower(p_name) AS en, count(*) AS tf, list_sort(list_distinct(list(p_brand))) AS zh FROM part WHERE p_partkey % 2 = 0 GROUP BY lower(p_name))"


@query("c13_merged_glossary", f"WITH {GLOSSARY} SELECT coalesce(o.en, n.en) AS en, coalesce(o.tf, n.tf) AS tf, array_to_string(list_concat(coalesce(o.zh, []), coalesce(n.zh, [])), ',') AS zh FROM o FULL JOIN n ON o.en = n.en")
def merged_glossary(spark, d):
    p = table(spark, d, "part")
    even = p.filter("p_partkey % 2 = 0").groupBy(F.lower("p_name").alias("en")).agg(F.count("*").alias("tf"), F.array_sort(F.collect_set("p_brand")).alias("zh"))
    return glossary.merged(_terms(spark, d, "p_name", "p_type"), even).select("en", "tf", F.array_join("zh", ",").alias("zh"))


@query("c13_translations", f"WITH {GLOSSARY}, r AS (SELECT unnest(zh) AS zh, en, tf FROM o) SELECT zh, en FROM r QUALIFY row_number() OVER (PARTITION BY zh ORDER BY length(en) DESC, tf DESC, en) = 1")
def translations(spark, d):
    return glossary.translations(_terms(spark, d, "p_name", "p_type"))


@query("c14_source_hits", f"WITH {CHUNKS}, s AS (SELECT DISTINCT doc_id, source, source_stem FROM chunks), e AS (SELECT doc_id, source_stem, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN upper(source) WHEN 2 THEN source || ' p' || (doc_id * 10 + 1) ELSE 'src99 ' || source END AS expected FROM s) SELECT doc_id, len(list_filter(regexp_extract_all(lower(expected), '[a-z0-9]+'), lambda t: NOT contains(regexp_replace(lower(source_stem), '[^a-z0-9]+', '', 'g'), t))) = 0 AS hit FROM e")
def source_hits(spark, d):
    s = chunks(spark, d).select("doc_id", "source", "source_stem").distinct()
    k = F.col("doc_id") % 4
    expected = F.when(k == 0, "").when(k == 1, F.upper("source")).when(k == 2, F.concat("source", F.lit(" p"), (F.col("doc_id") * 10 + 1).cast("string"))).otherwise(F.concat(F.lit("src99 "), "source"))
    return s.select("doc_id", text.source_tokens_hit(expected, F.col("source_stem")).alias("hit"))


@query("c15_not_prefetched", "WITH p AS (SELECT user_id, event_id FROM events WHERE event_id % 3 = 0), r AS (SELECT user_id, event_id, event_type FROM events WHERE (user_id, event_id) NOT IN (SELECT user_id, event_id FROM p)), o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1) SELECT user_id, event_id, event_type FROM o QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 8")
def not_prefetched(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    left = e.join(e.filter("event_id % 3 = 0").select("user_id", "event_id"), ["user_id", "event_id"], "left_anti")
    once = left.withColumn("n", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))).filter("n = 1")
    return once.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).filter("n <= 8").drop("n")


@query("c16_history_fallback", f"WITH {TURNS}, s AS (SELECT * FROM turns WHERE role IN ('user', 'assistant') AND conv_id % 3 <> 0), c AS (SELECT thread_id, pos, role, 'c: ' || content AS content FROM turns WHERE role IN ('user', 'assistant')), u AS (SELECT thread_id, pos, role, content FROM s UNION ALL SELECT * FROM c WHERE thread_id NOT IN (SELECT thread_id FROM s)) SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY pos DESC) <= 10")
def history(spark, d):
    t = turns(spark, d)
    server = conversation.recent(t.filter("conv_id % 3 <> 0"), limit=10).select("thread_id", "pos", "role", "content")
    client = conversation.recent(t.withColumn("content", F.concat(F.lit("c: "), "content")), limit=10).select("thread_id", "pos", "role", "content")
    return server.unionByName(client.join(server.select("thread_id").distinct(), "thread_id", "left_anti"))


@query("h10_inferred_stems")
def inferred(spark, d):
    registry = table(spark, d, "supplier").select(F.concat(F.lit("Press F"), (F.col("s_suppkey") % 40 + 100).cast("string"), F.lit(" model X"), F.col("s_suppkey").cast("string")).alias("base"))
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("press f"), (F.col("item_id") + 100).cast("string"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(" x"), F.col("item_id").cast("string"))).otherwise("")).alias("text"))
    return glossary.inferred_stems(q, registry)


@query("h09_glossary_replaced", "SELECT p_partkey, regexp_replace(regexp_replace(p_name, '(?i)\\bred\\b', 'crimson', 'g'), '(?i)\\bbolt\\b', 'threaded fastener', 'g') AS name FROM part")
def glossary_replaced(spark, d):
    from ..operators.layout import glossary_replaced as replaced

    return table(spark, d, "part").select("p_partkey", replaced({"red": "crimson", "bolt": "threaded fastener"})(F.col("p_name")).alias("name"))


@query("h09_glossary_terms")
def glossary_terms(spark, d):
    """All documents, by the merged glossary of their own frequent words and the parts' names: thousands of terms."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{4,}"), F.lit(0))).alias("en")).groupBy("en").agg(F.count("*").alias("tf")).filter("tf >= 5")
    merged_ = glossary.merged(found.withColumn("zh", F.array(F.concat(F.lit("<"), "en", F.lit(">")))), _terms(spark, d, "p_name", "p_type"))
    usable = terms.usable_terms(merged_.select(F.col("en").alias("term"), F.explode("zh").alias("target")))
    return docs.select("doc_id", terms.replacer(usable)("text").alias("r")).select("doc_id", "r.n", F.md5(F.col("r.text").cast("binary")).alias("text"))
