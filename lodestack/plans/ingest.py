"""Scans, sinks, incremental load and stores."""

from __future__ import annotations

import uuid
from urllib.parse import urlsplit

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ingest, scans
from ..sources import content_list, sidecar, snapshots, spool, tables
from ..sources.scratch import shared_folder
from .inputs import CHUNKS, REQUESTS, chunks, requests, table
from .registry import query


@query("a01_content_list_scan", f"WITH {CHUNKS} SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN count(*) ELSE 0 END AS items, CASE WHEN doc_id % 9 = 0 THEN 'broken' END AS finding FROM chunks GROUP BY doc_id")
def content_list_scan(spark, d):
    c = chunks(spark, d).groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("pos", F.lit("text").alias("type"), F.col("content").alias("text"))))).alias("json"))
    cut = F.when(F.col("doc_id") % 9 == 0, F.expr("substring(json, 1, length(json) - 3)")).otherwise(F.col("json"))
    return content_list.parsed(c.select("doc_id", cut.alias("json")), "json").select("doc_id", F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("items"), "finding")


FILES = "f AS (SELECT doc_id, source || '/' || CASE WHEN doc_id % 2 = 0 THEN 'auto' ELSE 'tmp' END || '/d' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '_v2' ELSE '' END || '_content_list.json' AS path FROM documents)"


@query("a02_discovery", f"WITH {FILES} SELECT regexp_extract(path, '/auto/([^/]*)_content_list\\.json$', 1) AS stem, path FROM f WHERE regexp_matches(path, '/auto/[^/]*_content_list\\.json$') AND NOT contains(path, '_v2')")
def discovery(spark, d):
    path = F.concat("source", F.lit("/"), F.when(F.col("doc_id") % 2 == 0, "auto").otherwise("tmp"), F.lit("/d"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, "_v2").otherwise(""), F.lit("_content_list.json"))
    return content_list.discovered(table(spark, d, "documents").select(path.alias("path")), "path").select("stem", "path")


@query("a02_files_read", f"WITH {FILES}, {CHUNKS}, c AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id) SELECT 'd' || doc_id AS stem, CASE WHEN doc_id % 9 <> 0 THEN n ELSE 0 END AS items, CASE WHEN doc_id % 9 = 0 THEN 'broken' END AS finding FROM f JOIN c USING (doc_id) WHERE doc_id % 2 = 0 AND doc_id % 5 <> 0")
def files_read(spark, d):
    """A file for each document, written, then listed and parsed: those in other folders and second versions are left aside."""
    i = F.col("doc_id")
    c = chunks(spark, d).groupBy("doc_id", "source").agg(F.to_json(F.array_sort(F.collect_list(F.struct("pos", F.lit("text").alias("type"), F.col("content").alias("text"))))).alias("json"))
    path = F.concat("source", F.lit("/"), F.when(i % 2 == 0, "auto").otherwise("tmp"), F.lit("/d"), i.cast("string"), F.when(i % 5 == 0, "_v2").otherwise(""), F.lit("_content_list.json"))
    root = f"{shared_folder(spark)}/layout-{uuid.uuid4().hex}"
    content_list.write(c.select(path.alias("path"), F.when(i % 9 == 0, F.expr("substring(json, 1, length(json) - 3)")).otherwise(F.col("json")).alias("json")), root)
    return content_list.read(spark, root).select("stem", F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("items"), "finding")


SPLIT = "s AS (SELECT 'f' || p_partkey AS stem, p_partkey % 1500 + 1 AS pages, p_size * 3.0::DOUBLE AS mib FROM part), p AS (SELECT *, CAST(CASE WHEN mib > 70 THEN greatest(10, least(500, floor(25 / (mib / pages)))) WHEN pages > 500 THEN 500 ELSE pages END AS INT) AS per FROM s)"


@query("a03_split_plan", f"WITH {SPLIT} SELECT stem, stem || '_p' || first || '-' || least(first + per - 1, pages) AS part, CAST(first AS INT) AS first, CAST(least(first + per - 1, pages) AS INT) AS last FROM (SELECT *, unnest(range(1, pages + 1, per)) AS first FROM p)")
def split_plan(spark, d):
    return ingest.split_plan(table(spark, d, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("stem"), (F.col("p_partkey") % 1500 + 1).alias("pages"), (F.col("p_size") * 3.0).alias("mib")))


@query("a03_parts_cover_all", f"WITH {SPLIT}, r AS (SELECT stem, pages, unnest(range(1, pages + 1, per)) AS first, per FROM p), k AS (SELECT stem, pages, first, least(first + per - 1, pages) AS last FROM r WHERE NOT (CAST(stem[2:] AS BIGINT) % 4 = 0 AND first > 1)) SELECT stem, sum(last - first + 1) = pages AS reusable FROM k GROUP BY stem, pages")
def cover_all(spark, d):
    files = table(spark, d, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("stem"), (F.col("p_partkey") % 1500 + 1).alias("pages"), (F.col("p_size") * 3.0).alias("mib"), "p_partkey")
    parts = ingest.split_plan(files).join(files.select("stem", "p_partkey"), "stem").filter(~((F.col("p_partkey") % 4 == 0) & (F.col("first") > 1)))
    return ingest.covers_all(parts.select("stem", "first", "last"), files.select("stem", "pages"))


@query("a05_scan", f"WITH {CHUNKS} SELECT source_stem, count(*) AS n, CAST(sum(char_count) AS BIGINT) AS chars FROM chunks GROUP BY source_stem")
def scan(spark, d):
    return chunks(spark, d).groupBy("source_stem").agg(F.count("*").alias("n"), F.sum("char_count").alias("chars"))


@query("a07_upsert", "WITH n AS (SELECT user_id, event_id, value FROM events WHERE event_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1), o AS (SELECT user_id, min(event_id) AS event_id, min(value) AS value FROM events WHERE event_id % 2 = 0 GROUP BY user_id) SELECT * FROM n UNION ALL SELECT * FROM o WHERE user_id NOT IN (SELECT user_id FROM n)")
def upsert(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    old = e.filter("event_id % 2 = 0").groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.min("value").alias("value"))
    return ingest.upserted(old, e.filter("event_id % 2 = 1"), ["user_id"], F.desc("event_id"))


@query("a08_replaced_documents", f"WITH {CHUNKS}, n AS (SELECT source_stem, chunk_id, 'new' AS v FROM chunks WHERE doc_id % 10 = 0 AND pos = 0) SELECT source_stem, chunk_id, v FROM n UNION ALL SELECT source_stem, chunk_id, 'old' FROM chunks WHERE source_stem NOT IN (SELECT source_stem FROM n)")
def replaced(spark, d):
    c = chunks(spark, d)
    new = c.filter("doc_id % 10 = 0 and pos = 0").select("source_stem", "chunk_id", F.lit("new").alias("v"))
    return ingest.replaced_documents(c.select("source_stem", "chunk_id", F.lit("old").alias("v")), new)


@query(
    "a08_committed_changes",
    f"""WITH {CHUNKS}, r AS (SELECT source_stem, chunk_id, 'new' AS v FROM chunks WHERE doc_id % 10 = 0 AND pos = 0), u AS (SELECT source_stem, chunk_id, 'touched' AS v FROM chunks WHERE doc_id % 10 = 1 AND pos % 2 = 0),
one AS (SELECT * FROM r UNION ALL SELECT source_stem, chunk_id, 'old' FROM chunks WHERE source_stem NOT IN (SELECT source_stem FROM r)), two AS (SELECT * FROM u UNION ALL SELECT * FROM one WHERE (source_stem, chunk_id) NOT IN (SELECT source_stem, chunk_id FROM u))
SELECT * FROM two WHERE source_stem NOT IN (SELECT source_stem FROM chunks WHERE doc_id % 15 = 7)""",
)
def committed(spark, d):
    """A table written, documents replaced, rows put in, documents deleted, each as a snapshot of its own, and read back."""
    c = chunks(spark, d)
    t = snapshots.SnapshotTable(spark, f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}", buckets=16)
    rows = lambda df, v: df.select("source_stem", "chunk_id", F.lit(v).alias("v"))
    t.replace(rows(c, "old"))
    t.replace(rows(c.filter("doc_id % 10 = 0 and pos = 0"), "new"))
    t.upsert(rows(c.filter("doc_id % 10 = 1 and pos % 2 = 0"), "touched"), ["source_stem", "chunk_id"])
    t.delete(c.filter("doc_id % 15 = 7").select("source_stem"))
    return t.read()


@query("a09_text_points", f"WITH {CHUNKS}, s AS (SELECT chunk_id, content, unnest(regexp_extract_all(lower(content), '[a-z]{{4,}}')) AS w FROM chunks), c AS (SELECT chunk_id, content, length(w) AS i, count(*) AS n FROM s GROUP BY ALL) SELECT chunk_id, content, string_agg(i, ',' ORDER BY i) AS indices, string_agg(n, ',' ORDER BY i) AS weights FROM c GROUP BY ALL")
def text_points(spark, d):
    # Word lengths stand for token ids, their counts for weights. Chunks that come again have the same words: they are counted, and then looked into.
    word, low = "[a-z]{4,}", F.lower("content")
    c = chunks(spark, d).select("chunk_id", "content").filter(low.rlike(word)).groupBy("chunk_id", "content").agg(F.count("*").alias("times"))
    lengths = F.transform(F.regexp_extract_all(low, F.lit(word), F.lit(0)), F.length)
    counted = lambda l: F.transform(F.array_distinct(l), lambda i: F.struct(i.alias("i"), (F.size(F.filter(l, lambda x: x == i)) * F.col("times")).alias("n")))  # noqa: E731, E741
    m = c.select("chunk_id", "content", F.map_from_entries(text.once(lengths, counted)).alias("sparse"))
    p = ingest.text_points(m, ["chunk_id", "content"])
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return p.select("chunk_id", "content", joined("indices"), joined("weights"))


@query("a10_image_points", "SELECT p_partkey, CASE WHEN t = '' THEN '[无描述]' ELSE t END AS desc_text FROM (SELECT p_partkey, trim(trim(CASE WHEN p_size % 3 = 0 THEN p_name ELSE '' END) || chr(10) || trim(CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END), ' ' || chr(10)) AS t FROM part WHERE p_size % 7 <> 0)")
def image_points(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.expr("p_size % 3 = 0"), F.col("p_name")).alias("caption"), F.when(F.expr("p_size % 2 = 0"), F.col("p_type")).alias("description"), F.array(F.lit(0), F.expr("p_size % 7")).alias("dense"))
    return ingest.image_points(p, ["p_partkey"])


JOBS = "j AS (SELECT 's' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS stem, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE md5(text) END AS m, doc_id FROM documents)"


@query(
    "a11_incremental_load",
    f"""WITH {JOBS}, done AS (SELECT stem, m FROM j WHERE doc_id % 10 = 0), kept AS (SELECT m, min(stem) AS kept_stem FROM done WHERE m IS NOT NULL GROUP BY m),
f AS (SELECT m, min(stem) AS first FROM j WHERE doc_id % 10 <> 0 AND m IS NOT NULL AND m NOT IN (SELECT m FROM kept) GROUP BY m), a AS (SELECT stem, doc_id % 10 = 0 AS d, coalesce(kept_stem, first) AS o FROM j LEFT JOIN kept USING (m) LEFT JOIN f USING (m))
SELECT stem, CASE WHEN d THEN 'done' WHEN o IS NOT NULL AND o <> stem THEN 'copy' ELSE 'load' END AS action, CASE WHEN NOT d AND o IS NOT NULL AND o <> stem THEN o END AS copy_of FROM a""",
)
def incremental(spark, d):
    j = table(spark, d, "documents").select(F.concat(F.lit("s"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("stem"), F.when(F.col("doc_id") % 13 != 0, F.md5(F.col("text").cast("binary"))).alias("md5"), "doc_id")
    done = j.filter("doc_id % 10 = 0")
    kept = done.filter("md5 is not null").groupBy("md5").agg(F.min("stem").alias("kept_stem"))
    return ingest.plan_jobs(j.drop("doc_id"), done, kept)


@query("a13_fingerprints", "SELECT doc_id, coalesce(md5(text), '') AS md5, coalesce(sha256(text), '') AS sha FROM documents")
def content_fingerprints(spark, d):
    t = F.col("text").cast("binary")
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.md5(t), F.lit("")).alias("md5"), F.coalesce(F.sha2(t, 256), F.lit("")).alias("sha"))


@query("a14_export", f"WITH {CHUNKS} SELECT chunk_id, 'text' AS chunk_type, content, NULL AS caption FROM chunks UNION ALL SELECT 'i' || p_partkey, 'image', NULL, p_name FROM part")
def export(spark, d):
    t = chunks(spark, d).select("chunk_id", F.lit("text").alias("chunk_type"), "content")
    i = table(spark, d, "part").select(F.concat(F.lit("i"), F.col("p_partkey").cast("string")).alias("chunk_id"), F.lit("image").alias("chunk_type"), F.col("p_name").alias("caption"))
    return t.unionByName(i, allowMissingColumns=True)


@query("a15_latest_wins", "SELECT conv_id, role, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1")
def latest_wins(spark, d):
    return ingest.latest(table(spark, d, "conversations").select("conv_id", "role", "turn", "text"), ["conv_id", "role"], F.desc("turn"))


@query("a16_user_store", "WITH n AS (SELECT c_name, c_nationkey FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'fresh' || c_custkey, c_nationkey FROM customer WHERE c_custkey % 50 = 0) SELECT c_name, c_nationkey FROM n WHERE c_name NOT IN (SELECT c_name FROM customer)")
def user_store(spark, d):
    c = table(spark, d, "customer")
    new = c.filter("c_custkey % 3 = 0").select("c_name", "c_nationkey").union(c.filter("c_custkey % 50 = 0").select(F.concat(F.lit("fresh"), F.col("c_custkey").cast("string")), "c_nationkey"))
    return new.join(c.select("c_name"), "c_name", "left_anti").select("c_name", "c_nationkey")


STORE = "o AS (SELECT conv_id AS id, conv_id % 7 AS user_id, max(turn) AS updated_at FROM conversations GROUP BY conv_id), n AS (SELECT id * 2 AS id, (id * 2) % 7 + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS user_id, updated_at + 100 AS updated_at FROM o)"


@query("a17_guarded_upsert", f"WITH {STORE}, a AS (SELECT n.* FROM n LEFT JOIN o USING (id) WHERE o.id IS NULL OR o.user_id = n.user_id) SELECT * FROM a UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM a)")
def conversation_store(spark, d):
    o = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id"), (F.col("conv_id") % 7).alias("user_id")).agg(F.max("turn").alias("updated_at"))
    n = o.select((F.col("id") * 2).alias("id"), ((F.col("id") * 2) % 7 + F.when(F.col("id") % 3 == 0, 1).otherwise(0)).alias("user_id"), (F.col("updated_at") + 100).alias("updated_at"))
    return ingest.guarded_upsert(o, n, "id", "user_id")


@query("a18_unique_keys", "SELECT c_custkey FROM (SELECT *, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'k' || (c_custkey % 5) END AS k FROM customer) WHERE k IS NULL OR true QUALIFY k IS NULL OR row_number() OVER (PARTITION BY c_nationkey, c_mktsegment, k ORDER BY c_custkey DESC) = 1")
def unique_keys(spark, d):
    c = table(spark, d, "customer").withColumn("k", F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("k"), (F.col("c_custkey") % 5).cast("string"))))
    keyed = ingest.latest(c.filter("k is not null"), ["c_nationkey", "c_mktsegment", "k"], F.desc("c_custkey"))
    return keyed.unionByName(c.filter("k is null")).select("c_custkey")


@query("a19_event_sequence", f"WITH {REQUESTS} SELECT event_id, username, row_number() OVER (PARTITION BY username ORDER BY ts, event_id) AS seq FROM requests")
def event_sequence(spark, d):
    r = requests(spark, d).select("event_id", "username", "ts")
    return scans.scan(r, ["username"], ["ts", "event_id"], {"seq": scans.Running("count", F.lit(True))}).select("event_id", "username", F.col("seq").cast("int").alias("seq"))


@query("a20_capped_log", "WITH n AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT event_id, user_id FROM n WHERE n <= 60 OR p > n // 2")
def capped_log(spark, d):
    return ingest.capped_log(table(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id", 60)


@query("a20_spool_replay", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS tries FROM events")
def spool_replay(spark, d):
    """All events as records of a spool, replayed in portions of 5000 for each core; every seventh fails once and comes again. The shared folder must be one that tasks open as files."""
    folder = urlsplit(f"{shared_folder(spark)}/spool-{uuid.uuid4().hex}").path
    table(spark, d, "events").select(F.to_json(F.struct("event_id")).alias("value")).write.text(f"{folder}/in")
    n = F.get_json_object("record", "$.event_id").cast("bigint")
    q = spool.replay(spark, f"{folder}/in", f"{folder}/done", lambda rows: rows.withColumn("ok", (n % 7 != 0) | (F.col("tries") > 0)), f"{folder}/checkpoint", records=5000, tasks=spark.sparkContext.defaultParallelism).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    done = spark.read.schema("record string, tries int").parquet(f"{folder}/done/records")
    return done.select(n.alias("event_id"), "tries")


@query("a21_replayed_once", "WITH r AS (SELECT event_id, event_id % 700 AS eid, event_id % 3 = 0 AS done FROM events) SELECT eid, min(event_id) AS event_id FROM r WHERE eid NOT IN (SELECT eid FROM r WHERE done AND event_id < 300) GROUP BY eid")
def replayed(spark, d):
    r = table(spark, d, "events").select("event_id", (F.col("event_id") % 700).alias("eid"))
    done = r.filter("event_id % 3 = 0 and event_id < 300").select("eid").distinct()
    return r.join(done, "eid", "left_anti").groupBy("eid").agg(F.min("event_id").alias("event_id"))


@query("a22_point_lookup", f"WITH {CHUNKS}, w AS (SELECT chunk_id FROM chunks WHERE pos = 1 AND doc_id % 5 = 0 UNION ALL SELECT 'i' || p_partkey FROM part WHERE p_partkey % 100 = 0 UNION ALL SELECT 'nothing__t1') SELECT w.chunk_id, coalesce(c.content, p.p_name) AS content, CASE WHEN regexp_matches(w.chunk_id, '__t\\d+$') THEN 'text' ELSE 'image' END AS first FROM w LEFT JOIN chunks c USING (chunk_id) LEFT JOIN part p ON 'i' || p.p_partkey = w.chunk_id")
def lookup(spark, d):
    c = chunks(spark, d)
    image = table(spark, d, "part").select(F.concat(F.lit("i"), F.col("p_partkey").cast("string")).alias("chunk_id"), F.col("p_name").alias("content"), "p_partkey")
    wanted = c.filter("pos = 1 and doc_id % 5 = 0").select("chunk_id").union(image.filter("p_partkey % 100 = 0").select("chunk_id")).union(spark.createDataFrame([("nothing__t1",)], "chunk_id string"))
    points = c.select("chunk_id", "content").unionByName(image.select("chunk_id", "content"))
    return wanted.join(points, "chunk_id", "left").select("chunk_id", "content", F.when(F.col("chunk_id").rlike(r"__t\d+$"), "text").otherwise("image").alias("first"))


@query("a23_object_keys", r"SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'kept/pdf/' || source || '/' || doc_id || '.jpg' WHEN 1 THEN 'kept/pptx/' || doc_id || '.jpg' WHEN 2 THEN 'cad/' || doc_id || '.dwg' END AS key FROM documents")
def object_keys(spark, d):
    k, i = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    path = (
        F.when(k == 0, F.concat(F.lit("D:\\clean\\"), "source", F.lit("\\"), i, F.lit(".jpg"))).when(k == 1, F.concat(F.lit("d:/clean/./pptx/"), i, F.lit(".jpg")))
        .when(k == 2, F.concat(F.lit("/clean/cad/"), i, F.lit(".dwg"))).when(k == 3, F.concat(F.lit("E:/clean/pdf/"), i)).otherwise(F.concat(F.lit("images/"), i))
    )
    return table(spark, d, "documents").select("doc_id", text.object_key(path).alias("key"))


@query("a25_live_tasks", "SELECT o_orderkey, o_orderdate AS started_at FROM orders WHERE o_orderdate > TIMESTAMP '2000-06-01' - INTERVAL 30 DAY AND o_orderdate <= TIMESTAMP '2000-06-01'")
def live_tasks(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("started_at")).filter("started_at > timestamp_ntz '2000-06-01' - interval 30 day and started_at <= timestamp_ntz '2000-06-01'")


@query("a26_quality_report", f"WITH {CHUNKS} SELECT content_type AS kind, count(*) AS points, count(*) FILTER (WHERE trim(content) <> '' AND length(content) > 40) AS described FROM chunks GROUP BY content_type")
def quality_report(spark, d):
    return chunks(spark, d).groupBy(F.col("content_type").alias("kind")).agg(F.count("*").alias("points"), F.count_if((F.trim("content") != "") & (F.length("content") > 40)).alias("described"))


_IMAGE_FIELDS = [f.split(" ", 1) for f in tables.IMAGE_CHUNK.split(", ")]


@query(
    "a06_collection_schema",
    "SELECT doc_id, concat_ws('/', " + ", ".join(f"typeof({c})" for c in ("chunk_id", "image_path", "page_num", "ingested_at", "dense")) + ") AS types, chunk_id, page_num, length(dense) AS dims, caption IS NULL AND description IS NULL AS bare FROM (SELECT vec_id AS doc_id, CAST(vec_id AS VARCHAR) AS chunk_id, 'd/' || vec_id || '.jpg' AS image_path, CAST(label AS INT) AS page_num, CAST(NULL AS DOUBLE) AS ingested_at, CAST(embedding AS FLOAT[]) AS dense, NULL AS caption, NULL AS description FROM embeddings)",
)
def collection_schema(spark, d):
    """Rows of any shape, conformed to the schema of the image collection."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("CHUNK_ID"), F.concat(F.lit("d/"), F.col("vec_id").cast("string"), F.lit(".jpg")).alias("image_path"), F.col("label").cast("string").alias("page_num"), F.col("embedding").cast("array<double>").alias("dense"), F.lit(1).alias("stray"))
    c = tables.conformed(e, tables.IMAGE_CHUNK)
    names = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "array<float>": "FLOAT[]"}
    types = "/".join(names[dict(c.dtypes)[f]] for f in ("chunk_id", "image_path", "page_num", "ingested_at", "dense"))
    assert c.columns == [f for f, _ in _IMAGE_FIELDS]
    return c.select(F.col("chunk_id").cast("bigint").alias("doc_id"), F.lit(types).alias("types"), "chunk_id", "page_num", F.size("dense").cast("bigint").alias("dims"), (F.col("caption").isNull() & F.col("description").isNull()).alias("bare"))


@query("a12_loaded_set", "SELECT DISTINCT 'd' || (doc_id // 3) AS stem FROM documents WHERE doc_id % 5 <> 0")
def loaded_set(spark, d):
    """The set of loaded stems from the lines of a side table, some of which are broken."""
    line = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit('{"stem": "d'), F.expr("doc_id div 3").cast("string"))).otherwise(F.to_json(F.struct(F.concat(F.lit("d"), F.expr("doc_id div 3").cast("string")).alias("stem"))))
    return sidecar.parsed(table(spark, d, "documents").select(line.alias("value")), "stem string").distinct()
