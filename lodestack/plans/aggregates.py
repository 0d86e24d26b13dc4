"""Aggregations and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import evaluation, glossary, layout, memory, metrics, ranking
from ..sources import logs
from .inputs import ARMS, CHUNKS, REQUESTS, arm, chunks, document_items, requests, table
from .registry import query


@query(
    "d01_request_stats",
    f"""WITH {REQUESTS}, l AS (SELECT latency_ms FROM requests ORDER BY event_id DESC LIMIT 1000), s AS (SELECT list_sort(list(latency_ms)) AS l, avg(latency_ms) AS a FROM l)
SELECT (SELECT count(*) FROM requests) AS total, (SELECT count(*) FROM requests WHERE error) AS errors, round((SELECT avg(CASE WHEN error THEN 1.0 ELSE 0 END) FROM requests), 4) AS error_rate, round((SELECT avg(CASE WHEN escalated THEN 1.0 ELSE 0 END) FROM requests), 4) AS escalation_rate,
 CAST(round(a) AS BIGINT) AS avg_ms, l[len(l) // 2 + 1] AS p50_ms, l[CAST(floor(len(l) * 0.95::DOUBLE) AS INT) + 1] AS p95_ms FROM s""",
)
def request_stats(spark, d):
    return metrics.totals(requests(spark, d))


def _by_sql(key: str) -> str:
    return f"""WITH {REQUESTS}, l AS (SELECT {key} AS k, list_sort(list(latency_ms)) AS l, CAST(round(avg(latency_ms)) AS BIGINT) AS avg_ms FROM (SELECT * FROM requests QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY event_id DESC) <= 1000) GROUP BY {key}),
s AS (SELECT {key} AS k, count(*) AS calls, count(*) FILTER (WHERE error) AS failures, count(*) FILTER (WHERE cache_hit) AS cache_hits, count(*) FILTER (WHERE escalated) AS escalations, CAST(sum(prompt) AS BIGINT) AS prompt, CAST(sum(completion) AS BIGINT) AS completion FROM requests GROUP BY {key})
SELECT k AS {key}, calls, failures, round((calls - failures) / calls, 4) AS success_rate, cache_hits, escalations, prompt, completion, avg_ms, l[least(len(l), CAST(floor(len(l) * 0.5::DOUBLE) AS INT) + 1)] AS p50_ms, l[least(len(l), CAST(floor(len(l) * 0.95::DOUBLE) AS INT) + 1)] AS p95_ms FROM s JOIN l USING (k)"""


@query("d02_tool_stats", _by_sql("tool"))
def tool_stats(spark, d):
    return metrics.by(requests(spark, d), "tool")


@query("d03_category_stats", f"WITH {REQUESTS} SELECT CASE WHEN tool IN ('click', 'view') THEN 'retrieval' ELSE 'other' END AS category, count(*) AS calls, count(*) FILTER (WHERE error) AS failures, round(1 - count(*) FILTER (WHERE error) / count(*), 4) AS success_rate FROM requests GROUP BY 1")
def category_stats(spark, d):
    r = requests(spark, d).withColumn("category", F.when(F.col("tool").isin("click", "view"), "retrieval").otherwise("other"))
    return r.groupBy("category").agg(F.count("*").alias("calls"), F.count_if("error").alias("failures")).withColumn("success_rate", F.round(1 - F.col("failures") / F.col("calls"), 4))


@query("d04_tier_stats", _by_sql("tier"))
def tier_stats(spark, d):
    return metrics.by(requests(spark, d), "tier")


@query("d05_hit_rate", f"WITH {REQUESTS} SELECT count(*) FILTER (WHERE cache_hit) AS hits, count(*) FILTER (WHERE NOT cache_hit) AS misses, round(count(*) FILTER (WHERE cache_hit) / count(*), 4) AS hit_rate FROM requests")
def hit_rate(spark, d):
    return metrics.hit_rate(requests(spark, d))


# Evaluation records: an event is a question of a user; scores come from its value.
RECORDS = """rec AS (SELECT event_id AS id, 'u' || (user_id % 10) AS username, CASE event_id % 4 WHEN 0 THEN NULL ELSE CASE event_id % 3 WHEN 0 THEN 'react' ELSE 'simple' END END AS expect_tier, CASE event_id % 3 WHEN 0 THEN 'react' ELSE 'raglite' END AS tier,
 CASE WHEN event_id % 5 <> 0 THEN 'src' END AS expect_source, event_id % 5 = 0 OR event_id % 2 = 0 AS source_hit, CASE WHEN event_id % 7 <> 0 THEN least(1.0, value / 100) END AS faith, event_type = 'error' AS refused, event_type = 'signup' AS chat, value AS latency, event_type AS reason, event_id % 9 = 0 AS hallucinated FROM events)"""


def records(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    return e.select(
        i.alias("id"), F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("username"), F.when(i % 4 != 0, F.when(i % 3 == 0, "react").otherwise("simple")).alias("expect_tier"), F.when(i % 3 == 0, "react").otherwise("raglite").alias("tier"),
        F.when(i % 5 != 0, "src").alias("expect_source"), ((i % 5 == 0) | (i % 2 == 0)).alias("source_hit"), F.when(i % 7 != 0, F.least(F.lit(1.0), F.col("value") / 100)).alias("faith"), (F.col("event_type") == "error").alias("refused"),
        (F.col("event_type") == "signup").alias("chat"), F.col("value").alias("latency"), F.col("event_type").alias("reason"), (i % 9 == 0).alias("hallucinated"),
    )


@query(
    "d06_evaluation_summary",
    f"""WITH {RECORDS} SELECT count(*) AS n, round(avg(faith), 4) AS faith, round(count(*) FILTER (WHERE source_hit) / greatest(1, count(expect_source)), 4) AS source_hit_rate_literal, round(count(*) FILTER (WHERE source_hit AND expect_source IS NOT NULL) / greatest(1, count(expect_source)), 4) AS source_hit_rate,
 round(count(*) FILTER (WHERE expect_tier IS NULL OR tier = expect_tier) / count(expect_tier), 4) AS tier_accuracy_literal, round(count(*) FILTER (WHERE tier = expect_tier) / count(expect_tier), 4) AS tier_accuracy, round(quantile_cont(latency, 0.5), 3) AS p50, round(quantile_cont(latency, 0.95), 3) AS p95 FROM rec""",
)
def evaluation_summary(spark, d):
    r, labelled = records(spark, d), F.count("expect_tier")
    hit = F.col("source_hit")
    right = F.col("tier") == F.col("expect_tier")
    return r.agg(
        F.count("*").alias("n"), F.round(F.avg("faith"), 4).alias("faith"),
        # The literal forms count rows without a label in the numerator only, and may exceed 1.
        F.round(F.count_if(hit) / F.greatest(F.lit(1), F.count("expect_source")), 4).alias("source_hit_rate_literal"), F.round(F.count_if(hit & F.col("expect_source").isNotNull()) / F.greatest(F.lit(1), F.count("expect_source")), 4).alias("source_hit_rate"),
        F.round(F.count_if(F.col("expect_tier").isNull() | right) / labelled, 4).alias("tier_accuracy_literal"), F.round(F.count_if(right) / labelled, 4).alias("tier_accuracy"),
        F.round(stats.linear(F.col("latency"), 0.5), 3).alias("p50"), F.round(stats.linear(F.col("latency"), 0.95), 3).alias("p95"),
    )


@query("d06_reason_histogram", f"WITH {RECORDS} SELECT coalesce(reason, 'unknown') AS reason, count(*) AS n FROM rec GROUP BY 1")
def reasons(spark, d):
    return records(spark, d).groupBy(F.coalesce("reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"))


@query("d07_fact_coverage", "WITH f AS (SELECT d.doc_id, d.text, CASE d.doc_id % 4 WHEN 0 THEN [] WHEN 1 THEN [[d.text[5:12]], ['no such fact']] WHEN 2 THEN [['none', d.text[1:6]]] ELSE [[''], [d.lang]] END AS facts FROM documents d) SELECT doc_id, round(CASE WHEN len(facts) = 0 THEN 1.0 ELSE len(list_filter(facts, lambda g: len(list_filter(g, lambda k: trim(k) <> '' AND contains(text, k))) > 0)) / len(facts) END, 6) AS coverage FROM f")
def fact_coverage(spark, d):
    k, t = F.col("doc_id") % 4, F.col("text")
    none = F.array().cast("array<array<string>>")
    facts = F.when(k == 0, none).when(k == 1, F.array(F.array(F.substring(t, 5, 8)), F.array(F.lit("no such fact")))).when(k == 2, F.array(F.array(F.lit("none"), F.substring(t, 1, 6)))).otherwise(F.array(F.array(F.lit("")), F.array("lang")))
    return table(spark, d, "documents").select("doc_id", F.round(evaluation.fact_coverage(t, facts), 6).alias("coverage"))


@query(
    "d08_judge_summary",
    f"WITH {RECORDS} SELECT count(*) AS judged, count(*) FILTER (WHERE chat) AS chitchat, count(*) FILTER (WHERE refused) AS refusals, round(avg(faith) FILTER (WHERE NOT chat AND NOT refused), 4) AS faith, count(*) FILTER (WHERE hallucinated AND NOT chat AND NOT refused) AS hallucinations, round(count(*) FILTER (WHERE hallucinated AND NOT chat AND NOT refused) / count(*) FILTER (WHERE NOT chat AND NOT refused), 4) AS hallucination_rate, round(avg(faith) FILTER (WHERE refused), 4) AS refusal_faith FROM rec",
)
def judge_summary(spark, d):
    kept = ~F.col("chat") & ~F.col("refused")
    return records(spark, d).agg(
        F.count("*").alias("judged"), F.count_if("chat").alias("chitchat"), F.count_if("refused").alias("refusals"), F.round(F.avg(F.when(kept, F.col("faith"))), 4).alias("faith"), F.count_if(F.col("hallucinated") & kept).alias("hallucinations"),
        F.round(F.count_if(F.col("hallucinated") & kept) / F.count_if(kept), 4).alias("hallucination_rate"), F.round(F.avg(F.when(F.col("refused"), F.col("faith"))), 4).alias("refusal_faith"),
    )


@query("d09_bucketed_report", f"WITH {RECORDS} SELECT reason, tier, count(*) AS n, round(avg(faith), 4) AS mean FROM rec GROUP BY GROUPING SETS ((reason), (tier))")
def bucketed(spark, d):
    return records(spark, d).groupingSets([["reason"], ["tier"]], "reason", "tier").agg(F.count("*").alias("n"), F.round(F.avg("faith"), 4).alias("mean"))


GLUE_Q = f"len(list_filter(regexp_extract_all(text, '[a-z]{{24,}}'), lambda t: regexp_matches(t[4:], '{text.GLUE_WORDS}')))"


@query(
    "d10_layout_quality",
    f"""WITH {CHUNKS}, i AS (SELECT doc_id, page_start AS page, CASE pos % 5 WHEN 2 THEN 'image' ELSE 'text' END AS type, content || CASE WHEN pos % 6 = 0 THEN '&amp;&#12;' ELSE '' END || CASE WHEN doc_id % 50 = 0 THEN repeat('�', 6) ELSE '' END AS text, pos % 5 <> 2 OR pos % 2 = 0 AS ok FROM chunks),
p AS (SELECT doc_id, page, count(*) AS items, sum(length(text)) AS chars, sum(length(text) - length(replace(text, '�', ''))) AS broken, sum(len(regexp_extract_all(text, '&(?:#x?[0-9a-fA-F]+|[a-zA-Z]+);'))) AS entities, sum({GLUE_Q}) AS glued, count(*) FILTER (WHERE type = 'image') AS images, count(*) FILTER (WHERE type = 'image' AND NOT ok) AS missing FROM i GROUP BY ALL),
s AS (SELECT doc_id, CAST(sum(items) AS BIGINT) AS items, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(broken) AS BIGINT) AS broken, CAST(sum(entities) AS BIGINT) AS entities, CAST(sum(images) AS BIGINT) AS images, CAST(sum(missing) AS BIGINT) AS missing, count(*) AS pages, count(*) FILTER (WHERE glued > 3) AS dense FROM p GROUP BY doc_id)
SELECT doc_id, items, chars, broken, entities, images, missing, pages, concat_ws(',', CASE WHEN broken >= 5 OR (chars > 0 AND broken / chars > 0.003) THEN 'garbled' END, CASE WHEN images / items > 0.6 AND chars / pages < 100 THEN 'scanned' END, CASE WHEN dense >= 2 THEN 'glued_words' END, CASE WHEN entities >= 50 THEN 'residual_html' END, CASE WHEN missing > 0 THEN 'missing_images' END) AS findings FROM s""",
)
def layout_quality(spark, d):
    p = F.col("pos")
    t = F.concat("content", F.when(p % 6 == 0, "&amp;&#12;").otherwise(""), F.when(F.col("doc_id") % 50 == 0, "�" * 6).otherwise(""))
    i = chunks(spark, d).select("doc_id", F.col("page_start").alias("page_idx"), F.when(p % 5 == 2, "image").otherwise("text").alias("type"), t.alias("text"), ((p % 5 != 2) | (p % 2 == 0)).alias("image_exists"))
    q = layout.quality(i)
    return q.select("doc_id", "items", "chars", "broken", "entities", "images", "missing", "pages", F.array_join(F.filter(F.split("findings", ","), lambda x: ~x.isin("long_items", "empty_pages")), ",").alias("findings"))


@query("d11_document_frequency", f"WITH {CHUNKS} SELECT source, content, count(DISTINCT doc_id) AS df FROM chunks GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3")
def document_frequency(spark, d):
    return chunks(spark, d).groupBy("source", "content").agg(F.count_distinct("doc_id").alias("df")).filter("df >= 3")


@query("a04_slides_without_noise", f"WITH {CHUNKS}, n AS (SELECT source, greatest(3, CAST(floor(0.4 * count(DISTINCT doc_id)) AS INT)) AS least FROM chunks GROUP BY source), f AS (SELECT source, content, count(DISTINCT doc_id) AS df FROM chunks GROUP BY ALL) SELECT chunk_id FROM chunks JOIN n USING (source) JOIN f USING (source, content) WHERE NOT ((length(content) <= 4 AND regexp_full_match(content, '\\d+|\\d+\\s*/\\s*\\d+')) OR (length(content) <= 80 AND regexp_matches(content, '{text.FOOTER}')) OR regexp_full_match(content, '[^\\p{{L}}\\p{{N}}]*') OR (df >= least AND length(content) <= 120))")
def slides(spark, d):
    c = chunks(spark, d)
    n = c.groupBy("source").agg(F.greatest(F.lit(3), F.floor(F.count_distinct("doc_id") * 0.4)).alias("least"))
    f = c.groupBy("source", "content").agg(F.count_distinct("doc_id").alias("df"))
    return c.join(f, ["source", "content"]).join(n, "source").filter(~text.is_noise(F.col("content"), F.col("df"), F.col("least"))).select("chunk_id")


# The documents' only characters beyond ASCII are letters; ``_`` stands for them, as RE2's word boundary knows ASCII only.
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_FOUND = lambda pattern: f"regexp_extract_all(t, '{pattern.removeprefix('(?U)')}')"
TERMS = f"""WITH d AS (SELECT regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') AS t FROM documents),
phrase AS (SELECT p FROM (SELECT unnest({_FOUND(glossary.PHRASE)}) AS p FROM d) WHERE NOT list_has_any(string_split(p, ' '), {_LIST(glossary.STOP + glossary.BOILERPLATE)})),
c AS (
  SELECT 4 AS least, 'multi' AS kind, p AS term FROM (SELECT unnest({_FOUND(glossary.MULTI)}) AS p FROM d) WHERE NOT list_has_any(regexp_split_to_array(lower(p), ' +'), {_LIST(glossary.EVERYDAY)})
  UNION ALL SELECT 8, 'acronym', unnest({_FOUND(glossary.ACRONYM)}) FROM d
  UNION ALL SELECT 4, 'model', lower(p) FROM (SELECT unnest({_FOUND(glossary.MODEL)}) AS p FROM d) WHERE length(p) >= 3
  UNION ALL SELECT 8, 'phrase', p FROM phrase
  UNION ALL SELECT 8, 'phrase', array_to_string(string_split(p, ' ')[1:2], ' ') FROM phrase WHERE length(p) - length(replace(p, ' ', '')) = 2
  UNION ALL SELECT 8, 'phrase', array_to_string(string_split(p, ' ')[2:3], ' ') FROM phrase WHERE length(p) - length(replace(p, ' ', '')) = 2
), n AS (SELECT kind, term, count(*) AS tf FROM c GROUP BY kind, term, least HAVING count(*) >= least)
SELECT arg_max(term, (tf, term)) AS term, max(tf) AS tf FROM n GROUP BY lower(term) ORDER BY tf DESC, term LIMIT 4000"""


@query("d12_terms", TERMS)
def terms(spark, d):
    return glossary.terms(table(spark, d, "documents"))


CONFLICT = f"""WITH {ARMS}, b AS (SELECT query_id, regexp_replace(source_stem, '_p\\d+(?:-\\d+)?$', '') AS family, greatest(0, max(score)) AS score FROM dense WHERE rank <= 4 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, family) AS n FROM b)
SELECT query_id, string_agg(family, ',' ORDER BY n) AS families FROM r WHERE n <= 4 GROUP BY query_id HAVING count(*) >= 2 AND max(score) FILTER (WHERE n = 1) - max(score) FILTER (WHERE n = 2) <= 0.02"""


@query("d13_family_conflicts", CONFLICT)
def conflicts(spark, d):
    return ranking.family_conflict(arm(spark, d, "dense"), margin=0.02)


@query("d14_best_of_each_book", f"WITH {ARMS}, o AS (SELECT query_id, chunk_id, score, label % 2 = 0 AS cited FROM dense QUALIFY row_number() OVER (PARTITION BY query_id, regexp_replace(source_stem, '_p\\d+(?:-\\d+)?$', '') ORDER BY score DESC, rank) = 1) SELECT query_id, chunk_id, cited, row_number() OVER (PARTITION BY query_id ORDER BY cited DESC, score DESC, chunk_id) AS rank FROM o QUALIFY rank <= 6")
def books(spark, d):
    return ranking.best_of_each_family(arm(spark, d, "dense"), F.col("label") % 2 == 0).select("query_id", "chunk_id", "cited", "rank")


@query("d15_stem_registry", f"WITH {CHUNKS} SELECT regexp_replace(source_stem, '_p\\d+[_-]\\d*$', '') AS base, count(DISTINCT source_stem) AS parts, string_agg(DISTINCT source_stem, ',' ORDER BY source_stem) AS stems FROM chunks GROUP BY 1")
def stem_registry(spark, d):
    g = chunks(spark, d).groupBy(text.scope_stem(F.col("source_stem")).alias("base")).agg(F.array_sort(F.collect_set("source_stem")).alias("s"))
    return g.select("base", F.size("s").cast("bigint").alias("parts"), F.array_join("s", ",").alias("stems"))


@query("d16_tag_groups", "SELECT p_brand || '/' || p_type AS tags, count(*) AS n, min(p_partkey) AS first, round(count(*) FILTER (WHERE p_size > 25) / count(*), 4) AS tagged FROM part GROUP BY 1")
def tag_groups(spark, d):
    return table(spark, d, "part").groupBy(F.concat_ws("/", "p_brand", "p_type").alias("tags")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"), F.round(F.count_if(F.col("p_size") > 25) / F.count("*"), 4).alias("tagged"))


@query("d17_profiles", "WITH o AS (SELECT 'u' || c_custkey AS username, c_name AS summary, [c_mktsegment] AS interests FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT 'u' || c_custkey AS username, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'new ' || c_custkey END AS summary, CASE WHEN c_custkey % 5 = 0 THEN [] ELSE ['x'] END AS interests FROM customer WHERE c_custkey % 6 < 4), c AS (SELECT 'u' || o_custkey AS username, count(*) AS n FROM orders GROUP BY o_custkey) SELECT username, coalesce(nullif(n.summary, ''), o.summary) AS summary, array_to_string(CASE WHEN len(n.interests) > 0 THEN n.interests ELSE coalesce(o.interests, []) END, ',') AS interests, coalesce(c.n, 0) AS fact_count FROM o FULL JOIN n USING (username) LEFT JOIN c USING (username)")
def profiles(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    user = F.concat(F.lit("u"), k.cast("string")).alias("username")
    old = c.filter(k % 2 == 0).select(user, F.col("c_name").alias("summary"), F.array("c_mktsegment").alias("interests"))
    new = c.filter(k % 6 < 4).select(user, F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("new "), k.cast("string"))).alias("summary"), F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))).alias("interests"))
    n = table(spark, d, "orders").groupBy(F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("username")).agg(F.count("*").alias("n"))
    return memory.refreshed_profiles(old, new, n).withColumn("interests", F.array_join("interests", ","))


@query("d18_distribution", "WITH t(kind, target) AS (VALUES ('view', 0.2), ('click', 0.2), ('purchase', 0.25), ('error', 0.15), ('other', 0.2)), n AS (SELECT event_type AS kind, count(*) / (SELECT count(*) FROM events) AS share FROM events GROUP BY event_type) SELECT kind, round(coalesce(share, 0), 4) AS share, round(abs(coalesce(share, 0) - CAST(target AS DOUBLE)), 4) AS deviation, round(abs(coalesce(share, 0) - CAST(target AS DOUBLE)), 6) <= 0.02 AS ok FROM t LEFT JOIN n USING (kind)")
def distribution(spark, d):
    targets = spark.createDataFrame([("view", 0.2), ("click", 0.2), ("purchase", 0.25), ("error", 0.15), ("other", 0.2)], "kind string, target double")
    e = table(spark, d, "events")
    n = e.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n")).join(F.broadcast(e.agg(F.count("*").alias("all"))))
    share = F.coalesce(F.col("n") / F.col("all"), F.lit(0.0))
    dev = F.abs(share - F.col("target"))
    return targets.join(n, "kind", "left").select("kind", F.round(share, 4).alias("share"), F.round(dev, 4).alias("deviation"), (F.round(dev, 6) <= 0.02).alias("ok"))


@query("d19_verdicts", f"WITH {RECORDS}, v AS (SELECT CASE WHEN id % 5 = 0 THEN 'doc_missed' WHEN coalesce(faith, 0) < 0.1 THEN 'anchor_missing' WHEN source_hit THEN 'in_topk' ELSE 'ranking_fail' END AS verdict FROM rec WHERE NOT refused AND coalesce(faith, 0) < 0.5) SELECT verdict, count(*) AS n, round(count(*) / (SELECT count(*) FROM v), 3) AS rate FROM v GROUP BY verdict")
def verdicts(spark, d):
    low = F.coalesce("faith", F.lit(0.0))
    v = records(spark, d).filter(~F.col("refused") & (low < 0.5)).select(F.when(F.col("id") % 5 == 0, "doc_missed").when(low < 0.1, "anchor_missing").when(F.col("source_hit"), "in_topk").otherwise("ranking_fail").alias("verdict"))
    n = v.groupBy("verdict").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("all")))).select("verdict", "n", F.round(F.col("n") / F.col("all"), 3).alias("rate"))


RUN = "SELECT round(count(*) FILTER (WHERE NOT refused) / count(*), 4) AS completion, round(count(*) FILTER (WHERE refused) / count(*), 4) AS error_rate, round(median(latency), 1) AS median_s, round(list_sort(list(latency))[CASE WHEN floor(count(*) * 0.95::DOUBLE) - 1 < 0 THEN count(*) ELSE CAST(floor(count(*) * 0.95::DOUBLE) AS INT) END], 1) AS p95_s FROM rec WHERE id % 2 = {half}"


@query(
    "d20_run_comparison",
    f"""WITH {RECORDS}, a AS ({RUN.format(half=0)}), b AS ({RUN.format(half=1)}), m AS (SELECT unnest(['completion', 'error_rate', 'median_s', 'p95_s']) AS metric, unnest([a.completion, a.error_rate, a.median_s, a.p95_s]) AS base, unnest([b.completion, b.error_rate, b.median_s, b.p95_s]) AS now FROM a, b)
SELECT metric, base, now, round(now - base, 4) AS delta, CASE WHEN metric = 'completion' THEN round(now - base, 4) < -0.02 ELSE round(now - base, 4) > 0.02 END AS regressed FROM m""",
)
def run_comparison(spark, d):
    def run(half):
        r = records(spark, d).filter(F.col("id") % 2 == half)
        shares = r.agg(F.round(F.count_if(~F.col("refused")) / F.count("*"), 4).alias("completion"), F.round(F.count_if("refused") / F.count("*"), 4).alias("error_rate"), F.count("latency").alias("n"))
        # Both are one row. The median lies between two places.
        middle = {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.floor(n / 2), "p95": stats.rank_place}
        g = shares.join(F.broadcast(stats.values_at(r, "latency", middle)), F.lit(True), "left").select("completion", "error_rate", F.round((F.col("low") + F.col("high")) / 2, 1).alias("median_s"), F.round("p95", 1).alias("p95_s"))
        return g.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in g.columns])).alias("x")).select("x.*")

    return evaluation.compared(run(1), run(0), ["completion"], 0.02)


@query("d21_heading_index", f"WITH {CHUNKS}, g AS (SELECT source_stem, heading_path, count(*) AS n, min(page_start) AS first_page, max(page_start) AS last_page, min(chunk_index) AS place FROM chunks GROUP BY source_stem, heading_path) SELECT source_stem, heading_path, n, first_page, last_page, row_number() OVER (PARTITION BY source_stem ORDER BY n DESC, place) AS rank FROM g")
def heading_index(spark, d):
    g = chunks(spark, d).groupBy("source_stem", "heading_path").agg(F.count("*").alias("n"), F.min("page_start").alias("first_page"), F.max("page_start").alias("last_page"), F.min("chunk_index").alias("at"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("source_stem").orderBy(F.desc("n"), "at"))).drop("at")


LOOSE = r"lower(regexp_replace({c}, '[^0-9A-Za-z\x{{4e00}}-\x{{9fff}}]', '', 'g'))"


@query(
    "d22_evidence_coverage",
    f"""WITH p AS (SELECT item_id, {LOOSE.format(c="b.text")} AS f, {LOOSE.format(c="d.text")} AS m FROM benchmark b JOIN documents d ON d.doc_id % (SELECT max(item_id) + 1 FROM benchmark) = b.item_id),
w AS (SELECT item_id, f, m, list_transform(range(1, length(f) - 10, 4), lambda i: f[i:i+11]) AS w FROM p), c AS (SELECT item_id, CASE WHEN length(f) > 12 THEN len(list_filter(w, lambda x: contains(m, x))) / len(w) ELSE CASE WHEN contains(m, f) THEN 1 ELSE 0 END END AS c FROM w)
SELECT item_id, round(max(c), 6) AS best, count(*) FILTER (WHERE c >= 0.6) AS passed FROM c GROUP BY item_id""",
)
def evidence(spark, d):
    pairs = document_items(spark, d).select("item_id", text.loose(F.col("fact")).alias("f"), text.loose(F.col("text")).alias("m"))
    c = pairs.withColumn("c", text.window_coverage(F.col("f"), F.col("m")))
    return c.groupBy("item_id").agg(F.round(F.max("c"), 6).alias("best"), F.count_if(F.col("c") >= 0.6).alias("passed"))


@query("d23_state_reducers", f"WITH {REQUESTS} SELECT username, CAST(sum(prompt) AS BIGINT) AS total, max(latency_ms) AS best, arg_max(tool, latency_ms * 1000000 - event_id) AS best_tool, bool_or(error) AS down FROM requests GROUP BY username")
def reducers(spark, d):
    return requests(spark, d).groupBy("username").agg(F.sum("prompt").alias("total"), F.max("latency_ms").alias("best"), F.max_by("tool", F.col("latency_ms") * 1_000_000 - F.col("event_id")).alias("best_tool"), F.bool_or("error").alias("down"))


@query("d24_shards")
def shards(spark, d):
    s = memory.shard_of(8)
    return table(spark, d, "customer").groupBy(s(F.when(F.col("c_custkey") % 10 != 0, F.col("c_name"))).alias("shard")).agg(F.count("*").alias("n"))


@query("d25_search_counts", f"WITH {REQUESTS} SELECT username, coalesce(max(latency_ms) FILTER (WHERE tool = 'view'), 0) AS best, count(*) FILTER (WHERE tool IN ('view', 'click') AND NOT error AND latency_ms > 50) AS searches FROM requests GROUP BY username")
def search_counts(spark, d):
    return requests(spark, d).groupBy("username").agg(F.coalesce(F.max(F.when(F.col("tool") == "view", F.col("latency_ms"))), F.lit(0)).alias("best"), F.count_if(F.col("tool").isin("view", "click") & ~F.col("error") & (F.col("latency_ms") > 50)).alias("searches"))


@query("d26_shingles", r"WITH s AS (SELECT item_id, regexp_replace(text, '\s+', '', 'g') AS t FROM benchmark) SELECT item_id, CAST(len(list_distinct(list_transform(range(1, length(t) - 6), lambda i: t[i:i+7]))) AS BIGINT) AS n FROM s")
def shingle_counts(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.size(text.shingles(F.col("text"))).cast("bigint").alias("n"))


@query("d27_log_blocks", "SELECT 'u' || user_id AS thread_id, CASE WHEN event_type = 'error' THEN 'timeout' ELSE 'served' END AS category, min(date_trunc('second', ts)) AS first, max(date_trunc('second', ts)) AS last, count(*) AS n FROM events GROUP BY ALL")
def log_blocks(spark, d):
    e = table(spark, d, "events")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.when(F.col("event_type") == "error", " ERROR timeout while serving").otherwise(" INFO served"))
    lines = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("thread_id"), F.col("event_id").alias("at"), F.explode(F.array(line, F.concat(F.lit("  detail "), "event_type"))).alias("line"))
    found = logs.sessions(logs.blocks(lines.withColumn("at", F.struct("at", (~F.col("line").rlike("^[0-9]")).alias("more")))), {"timeout": "timeout", "served": "served"})
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last")})


@query("d28_pattern_probes", f"WITH {CHUNKS}, p(name, rx) AS (VALUES ('number', '[0-9]{{3,}}'), ('mail', '[a-z0-9.]+@[a-z0-9.]+'), ('license', '(?i)licen[sc]e')) SELECT source, name, count(*) AS n, count(*) FILTER (WHERE content_type = 'table') AS tables FROM chunks, p WHERE regexp_matches(content, rx) GROUP BY ALL")
def probes(spark, d):
    patterns = {"number": "[0-9]{3,}", "mail": "[a-z0-9.]+@[a-z0-9.]+", "license": "(?i)licen[sc]e"}
    hit = F.filter(F.array(*[F.when(F.col("content").rlike(rx), F.lit(n)) for n, rx in patterns.items()]), lambda x: x.isNotNull())
    return chunks(spark, d).select("source", "content_type", F.explode(hit).alias("name")).groupBy("source", "name").agg(F.count("*").alias("n"), F.count_if(F.col("content_type") == "table").alias("tables"))


GOLD = "gold AS (SELECT q.vec_id AS query_id, g.vec_id AS chunk_id FROM embeddings q JOIN embeddings g ON q.label = g.label AND q.vec_id <> g.vec_id WHERE q.vec_id % 50 = 0)"


def gold(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label")
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    return q.join(v.withColumnRenamed("vec_id", "chunk_id"), "label").filter("query_id <> chunk_id").select("query_id", "chunk_id")


@query("d29_gold_ranks", f"WITH {ARMS}, {GOLD} SELECT query_id, chunk_id, d.rank, d.score FROM gold LEFT JOIN dense d USING (query_id, chunk_id)")
def gold_ranks(spark, d):
    """All gold pairs, also those that were not found."""
    return gold(spark, d).join(arm(spark, d, "dense").select("query_id", "chunk_id", "rank", "score"), ["query_id", "chunk_id"], "left")


@query("d30_arm_hits", f"WITH {ARMS}, {GOLD} SELECT query_id, count(*) FILTER (WHERE d.rank <= 4) > 0 AS dense, count(*) FILTER (WHERE s.rank <= 4) > 0 AS sparse FROM gold LEFT JOIN dense d USING (query_id, chunk_id) LEFT JOIN sparse s USING (query_id, chunk_id) GROUP BY query_id")
def arm_hits(spark, d):
    return evaluation.arm_hits({"dense": arm(spark, d, "dense"), "sparse": arm(spark, d, "sparse")}, gold(spark, d))


@query(
    "d_retrieval_measures",
    f"""WITH {ARMS}, {GOLD}, h AS (SELECT query_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1.0)) AS dcg FROM dense JOIN gold USING (query_id, chunk_id) WHERE rank <= 10 GROUP BY query_id), t AS (SELECT query_id, count(*) AS gold FROM gold GROUP BY query_id)
SELECT query_id, round(coalesce(hits, 0) / gold, 6) AS recall, round(coalesce(hits, 0) / 10, 6) AS precision, round(coalesce(1 / first, 0), 6) AS reciprocal_rank, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(gold, 10) + 1), lambda i: 1 / log2(i + 1.0))), 6) AS ndcg FROM t LEFT JOIN h USING (query_id)""",
)
def measures(spark, d):
    return evaluation.retrieval_measures(arm(spark, d, "dense"), gold(spark, d), 10)


@query("h21_bad_cases", f"WITH {RECORDS} SELECT id, concat_ws(',', CASE WHEN reason IN ('error', 'timeout') THEN 'failed' END, CASE WHEN expect_tier IS NOT NULL AND tier <> expect_tier THEN 'wrong_tier' END, CASE WHEN faith < 0.7 THEN 'unfaithful' END, CASE WHEN expect_source IS NOT NULL AND NOT source_hit THEN 'source_missed' END) AS tags FROM rec")
def bad_cases(spark, d):
    rules = [(F.col("reason").isin("error", "timeout"), "failed"), (F.col("expect_tier").isNotNull() & (F.col("tier") != F.col("expect_tier")), "wrong_tier"), (F.col("faith") < 0.7, "unfaithful"), (F.col("expect_source").isNotNull() & ~F.col("source_hit"), "source_missed")]
    return records(spark, d).select("id", F.array_join(F.array_compact(F.array(*[F.when(c, n) for c, n in rules])), ",").alias("tags"))


