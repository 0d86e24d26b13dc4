"""Operators on ranked candidates: tables of (query_id, chunk_id, score, rank, ...).

Rank is a column, from 1; every order ends with a key that breaks ties. All
work is partitioned by query, and a query's candidates are a few hundred rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import seat_stem, squashed

Q = "query_id"


def _by_query(*order) -> Window:
    return Window.partitionBy(Q).orderBy(*order)


def _whole() -> Window:
    return Window.partitionBy(Q)


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """Number each query's rows anew, by descending score or the order given."""
    return df.withColumn("rank", F.row_number().over(_by_query(*(order or (F.desc("score"), "chunk_id")))))


def fuse(arms: DataFrame, k: int = 60, limit: int = 192) -> DataFrame:
    """Reciprocal rank fusion of all arms: the sum of 1 / (k + rank); ties by id."""
    fused = arms.groupBy(Q, "chunk_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 10).alias("score"))
    return ranked(fused).filter(F.col("rank") <= limit)


def merge_weighted(a: DataFrame, b: DataFrame, weight: float = 0.7, k: int = 60) -> DataFrame:
    """Merge two ranked arms by rank, the second with a weight.

    Each row keeps its own arm's score (that of the first arm if it is in
    both); ties keep the order of the first arm, then of the second.
    """
    side = lambda df, n, w: df.select(Q, "chunk_id", "score", F.lit(n).alias("arm"), "rank", (F.lit(w) / (k + F.col("rank"))).alias("part"))
    both = side(a, 0, 1.0).unionByName(side(b, 1, weight))
    one = both.groupBy(Q, "chunk_id").agg(F.round(F.sum("part"), 10).alias("merged"), F.min(F.struct("arm", "rank", "score")).alias("own"))
    return ranked(one.select(Q, "chunk_id", "merged", F.col("own.arm").alias("arm"), F.col("own.rank").alias("place"), F.col("own.score").alias("score")), F.desc("merged"), "arm", "place")


def ratio_pool(df: DataFrame, ratio: float = 0.4, least: int = 32) -> DataFrame:
    """Prefix of each ranking: as many rows as have a score of ``ratio`` times
    that of the first-ranked row, ``least`` at least.
    """
    top = F.first("score").over(_by_query("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    kept = df.withColumn("__top", top)
    kept = kept.withColumn("__kept", F.sum((F.col("score") >= F.col("__top") * ratio).cast("int")).over(_whole()))
    return kept.filter(F.col("rank") <= F.greatest("__kept", F.lit(max(1, least)))).drop("__top", "__kept")


def cut(df: DataFrame, tau: float = 0.3, most: int = 8, least: int = 3, cliff: float = 0.6, fixed: int = 0) -> DataFrame:
    """Cut each ranking (by descending score).

    ``fixed`` > 0: that many rows. Otherwise the rows of a score of ``tau`` and
    more, ``most`` at most, or the first ``least`` if they are fewer; then all
    from the first row on that falls below ``cliff`` times its predecessor.
    The cliff comes last and may leave fewer than ``least``.
    """
    if fixed > 0:
        return df.filter(F.col("rank") <= fixed)
    over = F.least(F.sum((F.col("score") >= tau).cast("int")).over(_whole()), F.lit(most))
    out = df.withColumn("__n", over).withColumn("__n", F.when(F.col("__n") < least, F.lit(least)).otherwise(F.col("__n"))).filter(F.col("rank") <= F.col("__n"))
    if cliff > 0:
        fall = F.col("score") < cliff * F.lag("score").over(_by_query("rank"))
        out = out.withColumn("__fall", fall).withColumn("__edge", F.min(F.when(F.col("__fall"), F.col("rank"))).over(_whole()))
        out = out.filter(F.col("__edge").isNull() | (F.col("rank") < F.col("__edge"))).drop("__fall", "__edge")
    return out.drop("__n")


def grid_cut(df: DataFrame, settings: DataFrame) -> DataFrame:
    """Every setting (tau, cliff, k) on every ranking; the cliff compares with the top score here.

    A null tau cuts nothing. The grid of settings times all rows is what is asked
    for; Spark broadcasts the settings if they are as few as they should be.
    """
    top = F.max("score").over(Window.partitionBy(Q))
    rows = df.withColumn("__top", top).join(settings)
    ok = (F.col("tau").isNull() | (F.col("score") >= F.col("tau"))) & ((F.col("cliff") == 0) | (F.col("score") >= F.col("cliff") * F.col("__top"))) & (F.col("rank") <= F.col("k"))
    return rows.filter(ok).drop("__top")


def seat_cap(kept: DataFrame, rows: DataFrame, cap: int, tau: float = 0.3) -> DataFrame:
    """At most ``cap`` rows of one document family, as many rows as before.

    Freed seats go to other candidates of a score of ``tau`` and more, in rank
    order and within the cap; what is missing then goes back to the rows over
    the cap. The result is ordered by score.
    """
    if cap <= 0:
        return kept
    base = rows.withColumn("__doc", seat_stem(F.col("source_stem")))
    marked = base.join(kept.select(Q, "chunk_id", F.lit(True).alias("__in")), [Q, "chunk_id"], "left").withColumn("__in", F.coalesce("__in", F.lit(False)))
    per_doc = Window.partitionBy(Q, "__doc").orderBy(F.desc("__in"), "rank")
    # The kept rows of a family come first, then its candidates that may fill a seat.
    usable = F.col("__in") | (F.col("score") >= tau)
    seated = marked.filter(usable).withColumn("__seat", F.row_number().over(per_doc))
    # 0: kept within the cap; 1: refill within the cap; 2: kept over the cap.
    tier = F.when(F.col("__in") & (F.col("__seat") <= cap), 0).when(~F.col("__in") & (F.col("__seat") <= cap), 1).when(F.col("__in"), 2)
    sized = seated.withColumn("__tier", tier).withColumn("__n", F.sum(F.col("__in").cast("int")).over(_whole())).filter("__tier is not null")
    chosen = sized.withColumn("__place", F.row_number().over(_by_query("__tier", "rank"))).filter(F.col("__place") <= F.col("__n"))
    single = F.col("__n") <= 1
    return ranked(chosen.filter(~single | F.col("__in")).select(*rows.columns))


def first_of_each_text(df: DataFrame, text_col: str = "content") -> DataFrame:
    """Only the first row, by rank, of rows whose text is the same but for white space."""
    w = Window.partitionBy(Q, F.xxhash64(squashed(F.col(text_col))), squashed(F.col(text_col))).orderBy("rank")
    return ranked(df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n"), "rank")


def cascade(df: DataFrame, cheap: str, dear: str, keep: int = 24) -> DataFrame:
    """If a pool has more than ``keep`` rows, the best by the cheap score; ranked by the dear one."""
    pool = df.withColumn("__n", F.count("*").over(_whole())).withColumn("__c", F.row_number().over(_by_query(F.desc(cheap), "rank")))
    left = pool.filter((F.col("__n") <= keep) | (F.col("__c") <= keep)).drop("__n", "__c")
    return ranked(left.withColumn("score", F.col(dear)), F.desc(dear), "chunk_id")


def blend(df: DataFrame, first: str, second: str, weight: float = 0.6) -> Column:
    """Min-max blend of two score columns within a query.

    A constant arm counts 0.5; a single arm that is there comes unchanged;
    without any the result is null.
    """

    def scaled(c: str) -> Column:
        low, high = F.min(c).over(_whole()), F.max(c).over(_whole())
        return F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(F.lit(0.5))

    there = lambda c: F.count(c).over(_whole()) > 0
    return F.when(there(first) & there(second), weight * scaled(first) + (1 - weight) * scaled(second)).when(there(first), F.col(first)).when(there(second), F.col(second))


def boosted(df: DataFrame, in_scope: Column, factor: float = 1.35) -> DataFrame:
    """Scores inside the scope times a factor, ranked anew."""
    return ranked(df.withColumn("score", F.when(in_scope, F.col("score") * factor).otherwise(F.col("score"))), F.desc("score"), "rank")


def rescue_seat(out: DataFrame, hits: DataFrame, tau: float = 0.3) -> DataFrame:
    """Fixed top-k: a last row below ``tau`` gives way to the first lexical hit that is absent."""
    last = out.groupBy(Q).agg(F.max("rank").alias("__last"), F.max_by("score", "rank").alias("__low"))
    absent = hits.join(out.select(Q, "chunk_id"), [Q, "chunk_id"], "left_anti")
    first = absent.groupBy(Q).agg(F.min_by("chunk_id", "rank").alias("__new"))
    joined = out.join(last, Q).join(first, Q, "left")
    swap = (F.col("rank") == F.col("__last")) & (F.col("__low") < tau) & F.col("__new").isNotNull()
    return joined.select(
        Q, F.when(swap, F.col("__new")).otherwise(F.col("chunk_id")).alias("chunk_id"), F.when(swap, F.least(F.lit(tau * 0.9), F.col("__low"))).otherwise(F.col("score")).alias("score"), "rank"
    )


def rescue_append(out: DataFrame, hits: DataFrame, tau: float = 0.3) -> DataFrame:
    """Dynamic cut: absent lexical hits follow with a score of 0.9 tau."""
    absent = hits.join(out.select(Q, "chunk_id"), [Q, "chunk_id"], "left_anti").select(Q, "chunk_id", F.lit(tau * 0.9).alias("score"), (F.col("rank") + 100_000).alias("rank"))
    return ranked(out.select(Q, "chunk_id", "score", "rank").unionByName(absent), "rank")


def backfilled(kept: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Fill each query's kept rows up to k from its ranking."""
    marked = rows.join(kept.select(Q, "chunk_id", F.lit(0).alias("__tier")), [Q, "chunk_id"], "left").withColumn("__tier", F.coalesce("__tier", F.lit(1)))
    placed = marked.withColumn("__p", F.row_number().over(_by_query("__tier", "rank"))).withColumn("__n", F.sum(1 - F.col("__tier")).over(_whole()))
    return placed.filter(F.col("__p") <= F.greatest("__n", F.lit(k))).drop("__tier", "__p", "__n")


def ordered_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """First arm, then second, each id once; numbered in that order."""
    side = lambda df, n: df.select(Q, "chunk_id", "score", F.lit(n).alias("arm"), "rank")
    w = Window.partitionBy(Q, "chunk_id").orderBy("arm", "rank")
    once = side(first, 0).unionByName(side(second, 1)).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return ranked(once, "arm", "rank").drop("arm")


def merged_best(*results: DataFrame) -> DataFrame:
    """Union of results, each id with its best score, ordered by it."""
    rows = results[0].select(Q, "chunk_id", "score")
    for r in results[1:]:
        rows = rows.unionByName(r.select(Q, "chunk_id", "score"))
    return ranked(rows.groupBy(Q, "chunk_id").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("score")))


def with_pins(items: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` unpinned rows and every pinned one; (query_id, chunk_id, rank, pinned)."""
    w = Window.partitionBy(Q, "pinned").orderBy("rank")
    chosen = items.withColumn("__n", F.row_number().over(w)).filter(F.col("pinned") | (F.col("__n") <= cap))
    once = Window.partitionBy(Q, "chunk_id").orderBy("pinned", "rank")
    return chosen.withColumn("__d", F.row_number().over(once)).filter("__d = 1").drop("__n", "__d")


def with_neighbour(chunks: DataFrame, n: int = 500) -> DataFrame:
    """Add the next chunk of the document, ``n`` characters at most; null for the last one."""
    nxt = chunks.select("source_stem", (F.col("chunk_index") - 1).alias("chunk_index"), F.substring("content", 1, n).alias("next_content"))
    return chunks.join(nxt, ["source_stem", "chunk_index"], "left")


def with_siblings(chunks: DataFrame, longest: int = 200, most: int = 2, scanned: int = 8, n: int = 120) -> DataFrame:
    """For short chunks: the first chunks under the same heading of the document, joined by line ends."""
    near = chunks.select("source_stem", "heading_path", F.col("chunk_id").alias("other"), F.col("chunk_index").alias("at"), F.substring(F.trim("content"), 1, n).alias("text"))
    w = Window.partitionBy("source_stem", "heading_path").orderBy("at")
    near = near.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= scanned)
    short = chunks.filter((F.length("content") <= longest) & (F.trim("heading_path") != ""))
    pairs = short.join(near, ["source_stem", "heading_path"]).filter((F.col("other") != F.col("chunk_id")) & (F.col("text") != ""))
    pick = pairs.withColumn("p", F.row_number().over(Window.partitionBy("chunk_id").orderBy("at"))).filter(F.col("p") <= most)
    return pick.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "text"))), lambda x: x["text"]), "\n").alias("context"))


def family_conflict(df: DataFrame, top: int = 4, margin: float = 1.0) -> DataFrame:
    """Queries whose best two document families are within ``margin``; families in order, four at most.

    A family's score is its best one, 0 at least.
    """
    best = df.filter(F.col("rank") <= top).groupBy(Q, seat_stem(F.col("source_stem")).alias("family")).agg(F.greatest(F.lit(0.0), F.max("score")).alias("score"))
    lists = best.filter("family <> ''").groupBy(Q).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "family"))).alias("f"))
    near = (F.size("f") >= 2) & (F.get("f", F.lit(1))["s"] - F.get("f", F.lit(0))["s"] <= margin)
    return lists.filter(near).select(Q, F.array_join(F.transform(F.slice("f", 1, 4), lambda x: x["family"]), ",").alias("families"))


def best_of_each_family(df: DataFrame, cited: Column, k: int = 6) -> DataFrame:
    """The best chunk of each document family, cited families first, k rows."""
    w = Window.partitionBy(Q, seat_stem(F.col("source_stem"))).orderBy(F.desc("score"), "rank")
    one = df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").withColumn("cited", cited)
    return ranked(one.drop("__n"), F.desc("cited"), F.desc("score"), "chunk_id").filter(F.col("rank") <= k)
