"""Search composed of the ranking operators: all queries in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import seat_stem
from . import ranking


@dataclass(frozen=True)
class Settings:
    """Parameters of a search; the defaults are those in production."""

    score_ratio: float = 0.4
    pool_min: int = 32
    pool_limit: int = 192
    cascade_keep: int = 24
    weight: float = 0.6
    tau: float = 0.3
    most: int = 8
    least: int = 3
    cliff: float = 0.6
    fixed: int = 0
    doc_cap: int = 0
    boost: float = 1.35
    expanded: int = 2
    expanded_chars: int = 500


def hybrid(arms: list[DataFrame], exact: DataFrame | None, scored: DataFrame, scopes: DataFrame | None = None, settings: Settings = Settings(), rescue: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): recall arms fused, exact hits first, pool by
    ratio, copies out, cascade, blend of two scores, scope boost, cut, seat cap,
    rescued lexical hits, and the text that follows the first rows.

    ``scored``: query_id, chunk_id, first, second, content, source_stem; null
    scores stand for a scorer that failed. ``scopes``: query_id, base.
    ``rescue``: (query_id, chunk_id, rank) of hits that get a seat at the end, or
    with ``fixed`` the last seat if it is weak. ``chunks``: (chunk_id,
    source_stem, chunk_index, content), adds ``next_content`` to the first
    ``expanded`` rows; rescued rows have none.
    """
    s = settings
    rows = arms[0]
    for a in arms[1:]:
        rows = rows.select("query_id", "chunk_id", "rank").unionByName(a.select("query_id", "chunk_id", "rank"))
    pool = ranking.fuse(rows.select("query_id", "chunk_id", "rank"), limit=s.pool_limit)
    pool = ranking.ratio_pool(pool, s.score_ratio, s.pool_min)
    if exact is not None:
        pool = ranking.ordered_union(exact, pool)
    full = pool.join(scored, ["query_id", "chunk_id"])
    full = ranking.first_of_each_text(full)
    full = ranking.cascade(full, "second", "second", s.cascade_keep) if s.cascade_keep else full
    full = full.withColumn("__blend", F.round(ranking.blend(full, "first", "second", s.weight), 6))
    # Without any score the recall order stands.
    ranked = ranking.ranked(full.withColumn("score", F.coalesce("__blend", F.lit(0.0))).drop("__blend"), F.desc("score"), "rank")
    if scopes is not None:
        hits = scopes.select(F.col("query_id").alias("__q"), F.col("base").alias("__base"), F.lit(True).alias("__hit"))
        family = ranked.withColumn("__family", seat_stem(F.col("source_stem")))
        joined = family.join(hits, (F.col("query_id") == F.col("__q")) & (F.col("__family") == F.col("__base")), "left").drop("__q", "__base", "__family")
        ranked = ranking.boosted(joined, F.coalesce("__hit", F.lit(False)), s.boost).drop("__hit")
    kept = ranking.cut(ranked, s.tau, s.most, s.least, s.cliff, s.fixed)
    kept = ranking.seat_cap(kept, ranked, s.doc_cap, s.tau) if s.doc_cap else kept
    out = kept.select("query_id", "chunk_id", "score", "rank")
    if rescue is not None:
        out = ranking.rescue_seat(out, rescue, s.tau) if s.fixed else ranking.rescue_append(out, rescue, s.tau)
    if chunks is not None:
        first = kept.filter(F.col("rank") <= s.expanded).select("query_id", "chunk_id")
        here = chunks.join(first.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", "source_stem", (F.col("chunk_index") + 1).alias("chunk_index"))
        after = here.join(chunks.select("source_stem", "chunk_index", F.substring("content", 1, s.expanded_chars).alias("next_content")), ["source_stem", "chunk_index"])
        out = out.join(first.join(after.select("chunk_id", "next_content"), "chunk_id"), ["query_id", "chunk_id"], "left")
    return out


def batched(results: DataFrame, per_sub: int = 4) -> DataFrame:
    """Main and sub-queries in one table (query_id, sub, chunk_id, score, rank): sub 0 is the main one.

    Of every sub-question the first ``per_sub`` chunks that are new are pinned.
    """
    w = Window.partitionBy("query_id", "chunk_id").orderBy("sub", "rank")
    new = results.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    place = F.row_number().over(Window.partitionBy("query_id", "sub").orderBy("rank"))
    return new.withColumn("__p", place).filter((F.col("sub") == 0) | (F.col("__p") <= per_sub)).withColumn("pinned", F.col("sub") > 0).drop("__p")


def citations(rows: DataFrame, n: int = 160) -> DataFrame:
    """Sources as citations: a snippet and the score with four decimals."""
    return rows.select("query_id", "chunk_id", "source_stem", F.substring("content", 1, n).alias("snippet"), F.round("score", 4).alias("score"))


def lexical_score(query: Column, content: Column) -> Column:
    """Deterministic scorer: share of the query's distinct words that the content has."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    q = words(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, words(content))) / F.size(q)).otherwise(F.lit(0.0))
