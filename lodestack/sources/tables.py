"""Schemas of the stored tables, and how they are laid out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_CHUNK = (
    "chunk_id string, content string, embed_text string, source_path string, source_stem string, page_start int, page_end int, heading_path string, image_paths array<string>, image_descriptions array<string>, "
    "has_table boolean, table_html string, chunk_index int, char_count int, devices array<string>, content_type string, ingested_at double, dense array<float>, sparse map<int,float>"
)
IMAGE_CHUNK = (
    "chunk_id string, image_path string, description string, source_path string, source_stem string, page_num int, caption string, parent_text_chunk_id string, chunk_index int, item_type string, "
    "content_type string, ingested_at double, dense array<float>, desc_dense array<float>"
)
EVENT = ("thread_id string, seq bigint, type string, payload string, ts timestamp, sid string, uid string")
FACT = ("thread_id string, fid string, q string, a string, fp string, importance double, freq int, created_ts timestamp, last_access_ts timestamp, promoted boolean, long_ref string, degraded boolean")
LONG_MEMORY = (
    "id bigint, username string, category string, key string, content string, embedding array<float>, importance double, status string, source_thread string, hit_count int, last_hit_at timestamp, created_at timestamp, updated_at timestamp, shard int"
)
PROFILE = ("username string, display_prefs map<string,string>, summary string, top_interests array<string>, fact_count int")
RUN_RECORD = (
    "user string, id string, q string, source string, facts array<array<string>>, tier string, tier_expected string, answer string, sources array<struct<chunk_id:string,source_stem:string,page:string,heading:string,score:double,content:string>>, "
    "error string, done boolean, wall_s double, judge_faithfulness double, judge_context_precision double, judge_context_recall double, judge_answer_relevancy double, judge_chitchat boolean, judge_refusal boolean, has_hallucination boolean, judge_done boolean"
)


def schema(ddl: str) -> T.StructType:
    """The struct type of one of the texts above; needs a session."""
    return T.StructType.fromDDL(ddl)


def conformed(rows: DataFrame, ddl: str) -> DataFrame:
    """The schema's columns in its order, cast to its types; missing ones are null, others are left out."""
    have = {c.lower(): c for c in rows.columns}
    return rows.select(*[(F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(ddl)])


def write_by_document(rows: DataFrame, path: str, key: str = "source_stem", buckets: int = 64) -> None:
    """Parquet, partitioned by a hash of the document, so that replacing one rewrites one bucket.

    Only buckets that the rows have are replaced.
    """
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    bucketed.repartition("bucket").sortWithinPartitions(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
