"""Windows, sequences, sorts, limits and set operations on ranked candidates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import conversation, layout, memory, ranking, sparse, vector_lists
from .inputs import ARMS, CHUNKS, LEXICAL, LEXICAL_ARM, POOL, REQUESTS, TURNS, arm, chunks, questions, requests, table, text_index, turns, weighted_sql
from .registry import query

DENSE = "dense"


def both(spark, d):
    return arm(spark, d, "dense"), arm(spark, d, "sparse")


FUSED = ARMS + """, arms AS (SELECT query_id, chunk_id, rank FROM dense UNION ALL SELECT query_id, chunk_id, rank FROM sparse),
fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 10) AS score FROM arms GROUP BY ALL))"""


def lexical_arm(spark, d, k=POOL):
    """(query_id, chunk_id, score, rank) of the questions' words over all documents."""
    asked = questions(spark, d)
    index = text_index(spark, d, asked)
    return sparse.top_k(index, sparse.query_terms(index, asked), k)


@query(
    "e01_rank_fusion",
    f"""WITH {ARMS}, {LEXICAL_ARM}, arms AS (SELECT query_id, chunk_id, rank FROM dense UNION ALL SELECT query_id, chunk_id, rank FROM lexical)
SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank, round(score, 6) AS score FROM (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 10) AS score FROM arms GROUP BY ALL) QUALIFY rank <= 100""",
)
def fusion(spark, d):
    rows = lambda df: df.select("query_id", "chunk_id", "rank")
    return ranking.fuse(rows(arm(spark, d, DENSE)).unionByName(rows(lexical_arm(spark, d))), limit=100).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


ITEM_QUESTIONS = "items AS (SELECT item_id AS query_id, text FROM benchmark)"


@query("e01_lexical_recall", f"WITH {LEXICAL}, {ITEM_QUESTIONS}, {weighted_sql('items')} SELECT query_id, chunk_id, s AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS INT) AS rank FROM lscored WHERE s > 0 QUALIFY rank <= 20")
def lexical_recall(spark, d):
    """Every benchmark item asks all documents."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    index = text_index(spark, d, asked)
    return sparse.top_k(index, sparse.query_terms(index, asked), 20).select("query_id", "chunk_id", "score", "rank")


MERGED = ARMS + """, sides AS (SELECT query_id, chunk_id, score, 0 AS arm, rank, 1.0::DOUBLE / (60 + rank) AS part FROM dense UNION ALL SELECT query_id, chunk_id, score, 1, rank, 0.7::DOUBLE / (60 + rank) FROM sparse),
once AS (SELECT query_id, chunk_id, round(sum(part), 10) AS merged, arg_min(arm, arm * 1000 + rank) AS arm, arg_min(rank, arm * 1000 + rank) AS place, arg_min(score, arm * 1000 + rank) AS score FROM sides GROUP BY ALL),
merged AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY merged DESC, arm, place) AS INT) AS rank FROM once)"""


@query("e02_weighted_merge", f"WITH {MERGED} SELECT query_id, chunk_id, rank, score FROM merged")
def weighted(spark, d):
    return ranking.merge_weighted(*both(spark, d)).select("query_id", "chunk_id", "rank", "score")


@query(
    "e03_seat_cap",
    f"""WITH {ARMS}, base AS (SELECT *, regexp_replace(source_stem, '_p\\d+(?:-\\d+)?$', '') AS doc, rank <= 8 AS kept FROM dense), n AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc ORDER BY kept DESC, rank) AS seat FROM base WHERE kept OR score >= 0.1),
t AS (SELECT *, CASE WHEN kept AND seat <= 2 THEN 0 WHEN NOT kept AND seat <= 2 THEN 1 WHEN kept THEN 2 END AS tier FROM n), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, rank) AS place FROM t WHERE tier IS NOT NULL)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM p WHERE place <= 8""",
)
def seats(spark, d):
    a = arm(spark, d, DENSE)
    return ranking.seat_cap(ranking.cut(a, fixed=8), a, cap=2, tau=0.1).select("query_id", "chunk_id", "score", "rank")


# Layout items: the lines of a document, with kinds and heading levels by position.
ITEMS = CHUNKS + """, items AS (SELECT doc_id, pos, ['text', 'text', 'image', 'text', 'table', 'text', 'chart', 'text'][pos % 8 + 1] AS type, CASE WHEN pos % 10 = 0 THEN 1 WHEN pos % 10 = 4 THEN 2 WHEN pos % 10 = 7 AND doc_id % 2 = 0 THEN 3 END AS text_level,
  CASE WHEN pos % 8 IN (1, 3, 5) THEN (pos // 2 + 1) || '. ' ELSE '' END || content AS text FROM chunks)"""


def items(spark, d):
    kinds = ["text", "text", "image", "text", "table", "text", "chart", "text"]
    p = F.col("pos")
    level = F.when(p % 10 == 0, 1).when(p % 10 == 4, 2).when((p % 10 == 7) & (F.col("doc_id") % 2 == 0), 3)
    head = F.when((p % 8).isin(1, 3, 5), F.concat(F.expr("cast(pos div 2 + 1 as string)"), F.lit(". "))).otherwise("")
    return chunks(spark, d).select("doc_id", "pos", F.get(F.array(*map(F.lit, kinds)), (p % 8).cast("int")).alias("type"), level.alias("text_level"), F.concat(head, "content").alias("text"))


RUNS = ITEMS + r""", n AS (SELECT *, CASE WHEN type = 'text' AND text_level IS NULL THEN TRY_CAST(regexp_extract(trim(text), '^(\d{1,2})\s*[．.、)]\s*\S', 1) AS INT) END AS n FROM items WHERE type NOT IN ('image', 'chart', 'table')),
b AS (SELECT *, lag(n) OVER w AS p, lead(n) OVER w AS q FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), runs AS (SELECT doc_id, pos FROM b WHERE n IS NOT NULL AND (p = n - 1 OR q = n + 1))"""


@query("e04_list_runs", f"WITH {RUNS} SELECT doc_id, pos FROM runs")
def list_runs(spark, d):
    return layout.list_runs(items(spark, d))


@query(
    "e05_heading_paths",
    f"""WITH {ITEMS}, h AS (SELECT *, CASE WHEN type = 'text' THEN text_level END AS l FROM items), w AS (SELECT doc_id, pos, l,
  max(CASE WHEN l = 1 THEN pos END) OVER a AS p1, max(CASE WHEN l = 2 THEN pos END) OVER a AS p2, max(CASE WHEN l = 3 THEN pos END) OVER a AS p3,
  arg_max(text, pos) FILTER (WHERE l = 1) OVER a AS t1, arg_max(text, pos) FILTER (WHERE l = 2) OVER a AS t2, arg_max(text, pos) FILTER (WHERE l = 3) OVER a AS t3 FROM h WINDOW a AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, pos, coalesce(nullif(concat_ws(' > ', t1, CASE WHEN p2 > coalesce(p1, -1) THEN t2 END, CASE WHEN p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) THEN t3 END), ''), 'doc' || doc_id) AS path FROM w WHERE l IS NULL""",
)
def heading_paths(spark, d):
    level = F.when(F.col("type") == "text", F.col("text_level"))
    return layout.heading_paths(items(spark, d).withColumn("level", level), F.concat(F.lit("doc"), F.col("doc_id").cast("string"))).select("doc_id", "pos", "path")


@query("h05_sentence_ends")
def sentence_ends(spark, d):
    docs = table(spark, d, "documents").select("doc_id", layout.ends(F.col("text")).alias("ends"))
    return docs.select("doc_id", F.size("ends").cast("bigint").alias("n"), F.md5(F.array_join(F.col("ends").cast("array<string>"), ",").cast("binary")).alias("offsets"))


@query("h06_long_lines")
def long_lines(spark, d):
    docs = table(spark, d, "documents").select("doc_id", layout.pieces(F.col("text"), 800).alias("p"))
    return docs.select("doc_id", F.size("p").cast("bigint").alias("n"), F.md5(F.array_join("p", "\n").cast("binary")).alias("body"))


@query("e06_packed_chunks")
def packed(spark, d):
    c = chunks(spark, d).select(F.col("source_stem").alias("doc"), "pos", "heading_path", "content", F.coalesce(F.col("content_type") == "table", F.lit(False)).alias("is_table"))
    return layout.packed(c, target=500, most=800)


@query("e07_merged_tails")
def merged_tails(spark, d):
    c = chunks(spark, d).select(F.col("source_stem").alias("doc"), "pos", "heading_path", "content", F.lit(False).alias("is_table"))
    return layout.merged_tails(layout.packed(c, target=500, most=800), least=150, most=800)


COST = rf"CAST(floor(len(regexp_extract_all(content, '[\x{{4e00}}-\x{{9fff}}]')) + len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) * 1.3::DOUBLE) AS INT) + 4"


@query(
    "e08_token_budget",
    f"""WITH {TURNS}, m AS (SELECT thread_id, pos, role, {COST} AS cost, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY thread_id ORDER BY pos) AS turn FROM turns WHERE role <> 'system'),
s AS (SELECT thread_id, turn, min(pos) AS start, CAST(sum(cost) AS BIGINT) AS cost FROM m WHERE turn > 0 GROUP BY ALL), r AS (SELECT *, sum(cost) OVER (PARTITION BY thread_id ORDER BY turn DESC) AS total, max(turn) OVER (PARTITION BY thread_id) AS last FROM s)
SELECT thread_id, min(start) AS keep_from FROM r WHERE total <= 200 OR turn = last GROUP BY thread_id""",
)
def token_budget(spark, d):
    return conversation.kept_from(turns(spark, d), budget=200).select("thread_id", "keep_from")


@query("e09_recent_turns", f"WITH {TURNS} SELECT thread_id, pos, role, content FROM turns WHERE role IN ('user', 'assistant') AND pos > 1 AND trim(content) <> '' QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY pos DESC) <= 3")
def recent_turns(spark, d):
    return conversation.recent(turns(spark, d), after=1, limit=3).select("thread_id", "pos", "role", "content")


@query("e10_first_of_each_text", f"WITH {FUSED}, j AS (SELECT f.query_id, f.chunk_id, f.rank, regexp_replace(d.text, '\\s+', '', 'g') AS t FROM fused f JOIN documents d ON d.doc_id = f.chunk_id), o AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY query_id, t ORDER BY rank) = 1) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM o")
def dedup(spark, d):
    a, b = both(spark, d)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return ranking.first_of_each_text(ranking.fuse(a.unionByName(b)).join(docs, "chunk_id")).select("query_id", "chunk_id", "rank")


@query("e11_cursor_segments", f"WITH {TURNS}, s AS (SELECT thread_id, CAST(sum({COST}) FILTER (WHERE pos > 1) AS BIGINT) AS tokens, count(*) FILTER (WHERE pos > 1 AND role = 'user') AS turns FROM turns GROUP BY thread_id) SELECT thread_id, coalesce(tokens, 0) AS tokens, turns, coalesce(tokens, 0) >= 150 OR turns >= 3 AS due FROM s")
def segments(spark, d):
    return conversation.segments(turns(spark, d), F.lit(1), tokens=150, rounds=3).select("thread_id", "tokens", "turns", "due")


@query("e12_tool_pairs")
def tool_pairs(spark, d):
    t = turns(spark, d)
    call = F.when((F.col("role") == "assistant") & (F.col("pos") % 4 == 1), F.array(F.concat("thread_id", F.lit("#"), F.col("pos").cast("string")))).otherwise(F.array().cast("array<string>"))
    answer = F.when((F.col("role") == "user") & (F.col("pos") % 4 == 2), F.concat("thread_id", F.lit("#"), (F.col("pos") - 1).cast("string")))
    return conversation.compaction(t.withColumn("tool_call_ids", call).withColumn("tool_call_id", answer), trigger=100, budget=120, least_text=1)


@query("e13_latest_samples", f"WITH {REQUESTS}, l AS (SELECT tier, latency_ms FROM requests QUALIFY row_number() OVER (PARTITION BY tier ORDER BY event_id DESC) <= 1000) SELECT tier, count(*) AS n, CAST(sum(latency_ms) AS BIGINT) AS total FROM l GROUP BY tier")
def latest_samples(spark, d):
    from ..operators import metrics

    return metrics.latest(requests(spark, d), "tier", F.desc("event_id")).groupBy("tier").agg(F.count("*").alias("n"), F.sum("latency_ms").alias("total"))


@query("e14_equal_split", "WITH n AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM benchmark) SELECT item_id, (SELECT min(u) FROM range(1, 8) AS t(u) WHERE i < u * n // 7) AS part FROM n")
def equal_split(spark, d):
    from ..operators import evaluation

    return evaluation.equal_split(table(spark, d, "benchmark").select("item_id"), "item_id", 7)


@query("f01_top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
def top_k(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(20)


@query("f02_cascade", f"WITH {ARMS}, p AS (SELECT d.query_id, d.chunk_id, d.rank, d.score AS dear, s.s AS cheap FROM dense d JOIN scored s USING (query_id, chunk_id)), k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cheap DESC, rank) <= 24) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY dear DESC, chunk_id) AS rank FROM k")
def cascade(spark, d):
    a = arm(spark, d, DENSE)
    e = table(spark, d, "embeddings")
    lead = lambda side, name: e.select(F.col("vec_id").alias(side), F.slice("embedding", 1, 16).alias(name))
    from ..functions.vectors import dot

    pool = a.join(lead("chunk_id", "x"), "chunk_id").join(lead("query_id", "y"), "query_id").select("query_id", "chunk_id", "rank", F.col("score").alias("dear"), F.round(dot(F.col("x"), F.col("y")), 6).alias("cheap"))
    return ranking.cascade(pool, "cheap", "dear").select("query_id", "chunk_id", "rank")


@query("f03_scope_boost", f"WITH {ARMS}, b AS (SELECT query_id, chunk_id, rank AS old, CASE WHEN label = 3 THEN score * 1.35::DOUBLE ELSE score END AS score FROM dense) SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) AS rank FROM b")
def boost(spark, d):
    return ranking.boosted(arm(spark, d, DENSE), F.col("label") == 3).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


RESCUE = f"""WITH {ARMS}, o AS (SELECT query_id, chunk_id, score, rank FROM dense WHERE rank <= 5), l AS (SELECT query_id, max(rank) AS last, arg_max(score, rank) AS low FROM o GROUP BY query_id),
n AS (SELECT query_id, arg_min(chunk_id, rank) AS fresh FROM sparse s WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.query_id = s.query_id AND o.chunk_id = s.chunk_id) GROUP BY query_id)
SELECT query_id, CASE WHEN rank = last AND low < 0.5 AND fresh IS NOT NULL THEN fresh ELSE chunk_id END AS chunk_id, round(CASE WHEN rank = last AND low < 0.5 AND fresh IS NOT NULL THEN least(0.45, low) ELSE score END, 6) AS score, rank FROM o JOIN l USING (query_id) LEFT JOIN n USING (query_id)"""


@query("f04_rescue_seat", RESCUE)
def rescue(spark, d):
    a, b = both(spark, d)
    return ranking.rescue_seat(ranking.cut(a, fixed=5), b, tau=0.5).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("f04_rescue_append", f"WITH {ARMS}, o AS (SELECT query_id, chunk_id, score, rank FROM dense WHERE rank <= 5), a AS (SELECT query_id, chunk_id, 0.45 AS score, rank + 100000 AS rank FROM sparse s WHERE rank <= 2 AND NOT EXISTS (SELECT 1 FROM o WHERE o.query_id = s.query_id AND o.chunk_id = s.chunk_id)), u AS (SELECT * FROM o UNION ALL SELECT * FROM a) SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM u")
def rescue_append(spark, d):
    a, b = both(spark, d)
    return ranking.rescue_append(ranking.cut(a, fixed=5), b.filter("rank <= 2"), tau=0.5).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("f05_backfill", f"WITH {ARMS}, t AS (SELECT *, CASE WHEN score >= 0.3 AND rank <= 8 THEN 0 ELSE 1 END AS tier FROM dense), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, rank) AS p, sum(1 - tier) OVER (PARTITION BY query_id) AS n FROM t) SELECT query_id, chunk_id, rank FROM p WHERE p <= greatest(n, 10)")
def backfill(spark, d):
    a = arm(spark, d, DENSE)
    return ranking.backfilled(a.filter("score >= 0.3 and rank <= 8"), a, 10).select("query_id", "chunk_id", "rank")


GRID = [(t, c, k) for t in (None, 0.2, 0.4) for c in (0.0, 0.5, 0.7) for k in (3, 5)]
GOLD = "gold AS (SELECT q.vec_id AS query_id, g.vec_id AS chunk_id FROM embeddings q JOIN embeddings g ON q.label = g.label AND q.vec_id <> g.vec_id WHERE q.vec_id % 50 = 0)"


@query(
    "f06_parameter_grid",
    f"""WITH {ARMS}, {GOLD}, g(tau, cliff, k) AS (VALUES {", ".join(f"({'NULL' if t is None else t}::DOUBLE, {c}::DOUBLE, {k})" for t, c, k in GRID)}), t AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM dense),
s AS (SELECT g.tau, g.cliff, g.k, t.query_id, count(t.chunk_id) AS n, count(x.chunk_id) AS hits FROM g, t LEFT JOIN gold x USING (query_id, chunk_id) WHERE (g.tau IS NULL OR t.score >= g.tau) AND (g.cliff = 0 OR t.score >= g.cliff * t.top) AND t.rank <= g.k GROUP BY ALL),
q AS (SELECT DISTINCT query_id FROM dense), m AS (SELECT g.tau, g.cliff, g.k, avg(CASE WHEN coalesce(hits, 0) > 0 THEN 1.0 ELSE 0.0 END) AS r, avg(CASE WHEN coalesce(n, 0) > 0 THEN hits / n ELSE 0 END) AS p, avg(coalesce(n, 0)) AS size
  FROM g CROSS JOIN q LEFT JOIN s ON s.tau IS NOT DISTINCT FROM g.tau AND s.cliff = g.cliff AND s.k = g.k AND s.query_id = q.query_id GROUP BY ALL)
SELECT tau, cliff, k, round(r, 4) AS recall, round(p, 4) AS precision, round(CASE WHEN r + p > 0 THEN 2 * r * p / (r + p) ELSE 0 END, 4) AS f1, round(size, 2) AS mean_size FROM m""",
)
def grid(spark, d):
    from ..operators import evaluation

    settings = spark.createDataFrame(GRID, "tau double, cliff double, k int")
    v = table(spark, d, "embeddings").select("vec_id", "label")
    gold = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label").join(v.withColumnRenamed("vec_id", "chunk_id"), "label").filter("query_id <> chunk_id").select("query_id", "chunk_id")
    return evaluation.grid_report(arm(spark, d, DENSE), gold, settings)


# A user's memories: the vectors of one label; its questions are the vectors divisible by 50.
MEMORIES = "m AS (SELECT vec_id AS id, 'u' || label AS username, 'c' || (vec_id % 40) AS content, CAST(embedding AS DOUBLE[]) AS e, CASE WHEN vec_id % 9 = 0 THEN 'retired' ELSE 'active' END AS status FROM embeddings), q AS (SELECT vec_id AS query_id, 'u' || label AS username, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 50 = 0)"
DISTANCE = "round(1 - list_dot_product(q.e, m.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(m.e, m.e))), 6) + 0.0"
RECALL = f"WITH {MEMORIES}, r AS (SELECT query_id, id, content, {DISTANCE} AS distance FROM q JOIN m USING (username) WHERE status = 'active'), o AS (SELECT * FROM r WHERE distance <= {{far}} QUALIFY row_number() OVER (PARTITION BY query_id, content ORDER BY distance, id) = 1) SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM o QUALIFY rank <= 5"


def memories(spark, d):
    e = table(spark, d, "embeddings")
    m = e.select(F.col("vec_id").alias("id"), F.concat(F.lit("u"), F.col("label").cast("string")).alias("username"), F.concat(F.lit("c"), (F.col("vec_id") % 40).cast("string")).alias("content"), "embedding", F.when(F.col("vec_id") % 9 == 0, "retired").otherwise("active").alias("status"))
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("u"), F.col("label").cast("string")).alias("username"), F.col("embedding").alias("question_embedding"))
    return m, q


@query("f07_prefetched_memories", RECALL.format(far=0.4))
def prefetched(spark, d):
    return memory.recall(*memories(spark, d), farthest=0.4).select("query_id", "id", "distance", "rank")


@query("i08_memory_recall", RECALL.format(far=9))
def recalled(spark, d):
    return memory.recall(*memories(spark, d)).select("query_id", "id", "distance", "rank")


@query("i08_lists_read")
def lists_read(spark, d):
    """How many lists of its user's memories a question looked into, and how many of them hold its result."""
    m, q = memories(spark, d)
    found, reads = vector_lists.searched(memory.memory_lists(m), memory.asked_by_user(q))
    return reads.join(found.groupBy("query_id").agg(F.count("*").alias("found")), "query_id", "left")


TERMS = "t AS (SELECT lower(w) AS term, count(*) AS tf FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS w FROM documents) GROUP BY lower(w))"


@query("f08_top_terms", f"WITH {TERMS} SELECT term, tf FROM t ORDER BY tf DESC, term LIMIT 50")
def top_terms(spark, d):
    w = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("w"))
    return w.groupBy(F.lower("w").alias("term")).agg(F.count("*").alias("tf")).orderBy(F.desc("tf"), "term").limit(50)


@query("g01_ordered_union", f"WITH {ARMS}, u AS (SELECT query_id, chunk_id, 0 AS arm, rank FROM sparse WHERE rank <= 6 UNION ALL SELECT query_id, chunk_id, 1, rank FROM dense WHERE rank <= 30), o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY arm, rank) = 1) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY arm, rank) AS rank FROM o")
def ordered_union(spark, d):
    a, b = both(spark, d)
    return ranking.ordered_union(b.filter("rank <= 6"), a.filter("rank <= 30")).select("query_id", "chunk_id", "rank")


@query("g02_merged_best", f"WITH {ARMS}, u AS (SELECT query_id, chunk_id, score FROM dense WHERE rank <= 10 UNION ALL SELECT query_id, chunk_id, score FROM sparse WHERE rank <= 10), b AS (SELECT query_id, chunk_id, max(score) AS score FROM u GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM b")
def merged_best(spark, d):
    a, b = both(spark, d)
    return ranking.merged_best(a.filter("rank <= 10"), b.filter("rank <= 10"))


@query("g03_pinned_seats", f"WITH {ARMS}, i AS (SELECT query_id, chunk_id, rank, label = 4 AS pinned FROM dense WHERE rank <= 40) SELECT query_id, chunk_id, rank, pinned FROM i QUALIFY pinned OR row_number() OVER (PARTITION BY query_id, pinned ORDER BY rank) <= 6")
def pinned(spark, d):
    i = arm(spark, d, DENSE).filter("rank <= 40").select("query_id", "chunk_id", "rank", (F.col("label") == 4).alias("pinned"))
    return ranking.with_pins(i, 6).select("query_id", "chunk_id", "rank", "pinned")


@query(
    "g04_unsourced_numbers",
    r"""WITH n AS (SELECT doc_id, list_distinct(list_filter(list_transform(regexp_extract_all(text, '\d[\d,，]*(?:\.\d+)?'), lambda x: TRY_CAST(regexp_replace(x, '[,，]', '', 'g') AS DOUBLE)), lambda y: y >= 10)) AS a,
 list_distinct(list_filter(list_transform(regexp_extract_all(text[1:length(text) // 2], '\d[\d,，]*(?:\.\d+)?'), lambda x: TRY_CAST(regexp_replace(x, '[,，]', '', 'g') AS DOUBLE)), lambda y: y >= 10)) AS s FROM documents)
SELECT doc_id, CAST(len(list_filter(a, lambda x: NOT list_contains(s, x))) AS BIGINT) AS n FROM n""",
)
def unsourced(spark, d):
    a, s = text.numbers(F.col("text")), text.numbers(F.expr("substring(text, 1, cast(length(text) div 2 as int))"))
    return table(spark, d, "documents").select("doc_id", F.size(F.array_except(a, s)).cast("bigint").alias("n"))


@query("g05_arm_overlap", f"WITH {ARMS}, a AS (SELECT query_id, list(chunk_id) AS a FROM dense WHERE rank <= 80 GROUP BY query_id), b AS (SELECT query_id, list(chunk_id) AS b FROM sparse WHERE rank <= 80 GROUP BY query_id) SELECT query_id, CAST(len(list_intersect(a, b)) AS BIGINT) AS shared, CAST(len(list_distinct(list_concat(a, b))) AS BIGINT) AS candidates FROM a JOIN b USING (query_id)")
def overlap(spark, d):
    a, b = both(spark, d)
    ids = lambda df, n: df.filter("rank <= 80").groupBy("query_id").agg(F.collect_list("chunk_id").alias(n))
    return ids(a, "a").join(ids(b, "b"), "query_id").select("query_id", F.size(F.array_intersect("a", "b")).cast("bigint").alias("shared"), F.size(F.array_union("a", "b")).cast("bigint").alias("candidates"))


@query("g06_array_union", "SELECT p_brand, string_agg(v, ',' ORDER BY k) AS names FROM (SELECT p_brand, v, min(k) AS k FROM (SELECT p_brand, p_type AS v, p_partkey AS k FROM part UNION ALL SELECT p_brand, p_name, p_partkey + 1000000 FROM part WHERE p_partkey < 50) GROUP BY ALL) GROUP BY p_brand")
def array_union(spark, d):
    p = table(spark, d, "part")
    lists = lambda df, c, n: df.groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", c))), lambda x: x[c]).alias(n))
    both_ = lists(p, "p_type", "a").join(lists(p.filter("p_partkey < 50"), "p_name", "b"), "p_brand", "left")
    return both_.select("p_brand", F.array_join(F.array_distinct(F.concat("a", F.coalesce("b", F.array().cast("array<string>")))), ",").alias("names"))


@query("g07_streamed_sources", f"WITH {REQUESTS}, s AS (SELECT username, tool AS source, max(latency_ms) AS score FROM requests GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY username ORDER BY score DESC, source) AS rank FROM s")
def streamed_sources(spark, d):
    s = requests(spark, d).groupBy("username", F.col("tool").alias("source")).agg(F.max("latency_ms").alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("username").orderBy(F.desc("score"), "source")))
