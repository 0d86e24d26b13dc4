"""Evaluation of retrieval and answers: joins with gold sets, reports and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranking

Q = "query_id"


def grid_report(rows: DataFrame, gold: DataFrame, settings: DataFrame) -> DataFrame:
    """Recall, precision, F1 and mean size of every setting (tau, cliff, k) over all queries with a ranking."""
    same = ["tau", "cliff", "k"]
    chosen = ranking.grid_cut(rows.select(Q, "chunk_id", "score", "rank"), settings).join(gold.select(Q, "chunk_id", F.lit(1).alias("hit")), [Q, "chunk_id"], "left")
    per = chosen.groupBy(*same, Q).agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    # Queries that a setting leaves nothing count as zeros.
    sums = per.groupBy(*same).agg(F.sum((F.col("hits") > 0).cast("int")).alias("r"), F.sum(F.col("hits") / F.col("n")).alias("p"), F.sum("n").alias("n"))
    count = rows.agg(F.count_distinct(Q).alias("queries"))
    named = sums.withColumnsRenamed({c: f"{c}_s" for c in same})
    match = settings["tau"].eqNullSafe(named["tau_s"]) & (settings["cliff"] == named["cliff_s"]) & (settings["k"] == named["k_s"])
    joined = settings.join(named, match, "left").join(F.broadcast(count))  # one row
    z = lambda c: F.coalesce(c, F.lit(0))
    r, p = z(F.col("r")) / F.col("queries"), z(F.col("p")) / F.col("queries")
    f1 = F.when(r + p > 0, 2 * r * p / (r + p)).otherwise(0.0)
    return joined.select(*same, F.round(r, 4).alias("recall"), F.round(p, 4).alias("precision"), F.round(f1, 4).alias("f1"), F.round(z(F.col("n")) / F.col("queries"), 2).alias("mean_size"))


def equal_split(rows: DataFrame, order: str, parts: int) -> DataFrame:
    """Part 1 to ``parts`` of each row: part i has the places from (i - 1) * n / parts up to i * n / parts.

    Places are counted by range partitions, so no task sorts all rows.
    """
    ordered = rows.repartitionByRange(order).withColumn("__part", F.spark_partition_id())
    ordered = ordered.withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy(order)))
    sizes = ordered.groupBy("__part").agg(F.count("*").alias("__n"))
    # One row for each partition.
    before = sizes.withColumns({"__before": F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "__all": F.sum("__n").over(Window.partitionBy())})
    placed = ordered.join(F.broadcast(before), "__part").withColumn("__i", F.col("__before") + F.col("__in") - 1)
    part = F.expr(f"cast((__i * {parts} + {parts}) div __all as bigint)")
    # The smallest i with place < floor(i * n / parts).
    fits = lambda i: F.col("__i") < F.floor(i * F.col("__all") / parts)
    first = F.array_min(F.filter(F.sequence(F.greatest(F.lit(1), part - 1), part + 2), fits))
    return placed.select(*rows.columns, first.cast("bigint").alias("part"))


def fact_coverage(answer: Column, facts: Column) -> Column:
    """Share of the fact groups of which a keyword is in the answer; 1 without facts."""
    hit = lambda g: F.exists(g, lambda k: (F.trim(k) != "") & F.contains(F.coalesce(answer, F.lit("")), k))
    return F.when(F.coalesce(F.size(facts), F.lit(0)) <= 0, 1.0).otherwise(F.size(F.filter(facts, hit)) / F.size(facts))


def gold_ranks(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """Rank of every gold chunk, null where the ranking lacks it."""
    return gold.select(Q, "chunk_id").join(rows.select(Q, "chunk_id", "rank"), [Q, "chunk_id"], "left")


def retrieval_measures(rows: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Per query: recall and precision at k, reciprocal rank and NDCG at k."""
    hits = rows.filter(F.col("rank") <= k).join(gold.select(Q, "chunk_id"), [Q, "chunk_id"], "left_semi")
    per = hits.groupBy(Q).agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    total = gold.groupBy(Q).agg(F.count("*").alias("gold"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return total.join(per, Q, "left").select(
        Q, F.round(z("hits") / F.col("gold"), 6).alias("recall"), F.round(z("hits") / k, 6).alias("precision"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"), F.round(z("dcg") / ideal, 6).alias("ndcg")
    )


def arm_hits(arms: dict[str, DataFrame], gold: DataFrame, k: int = 4) -> DataFrame:
    """Per query: whether each arm has a gold chunk among its first k."""
    out = gold.select(Q).distinct()
    for name, rows in arms.items():
        hit = rows.filter(F.col("rank") <= k).join(gold.select(Q, "chunk_id"), [Q, "chunk_id"], "left_semi").select(Q).distinct().withColumn(name, F.lit(True))
        out = out.join(hit, Q, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))
    return out


def funnel(stages: list[tuple[str, DataFrame]], gold: DataFrame) -> DataFrame:
    """Per query and stage: the best gold rank, and the first stage that lost all gold chunks."""
    out = gold.select(Q).distinct()
    for name, rows in stages:
        best = rows.join(gold.select(Q, "chunk_id"), [Q, "chunk_id"], "left_semi").groupBy(Q).agg(F.min("rank").alias(name))
        out = out.join(best, Q, "left")
    lost = F.coalesce(*[F.when(F.col(name).isNull(), name) for name, _ in stages])
    return out.withColumn("lost_at", lost)


def compared(current: DataFrame, baseline: DataFrame, better_up: list[str], tolerance: float) -> DataFrame:
    """(metric, base, now, delta, regressed) of two tables (metric, value); null values are skipped."""
    both = baseline.select("metric", F.col("value").alias("base")).join(current.select("metric", F.col("value").alias("now")), "metric", "full_outer")
    delta = F.round(F.col("now") - F.col("base"), 4)
    bad = F.when(F.col("metric").isin(better_up), delta < -tolerance).otherwise(delta > tolerance)
    return both.select("metric", "base", "now", delta.alias("delta"), F.coalesce(bad, F.lit(False)).alias("regressed"))
