"""The percentile definitions in use, as aggregates or as places in sorted values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def linear(c: Column, q: float) -> Column:
    """Aggregate: interpolated between the neighbours of rank q * (n - 1); 0 for no values."""
    return F.coalesce(F.percentile(c, F.lit(q)), F.lit(0.0))


def nearest_place(n: Column, q: float = 0.95) -> Column:
    """min(n - 1, int(n * q)), counted from 0."""
    return F.least(n - 1, F.floor(n * F.lit(q)))


def floor_place(n: Column) -> Column:
    """int(0.95 n)."""
    return F.floor(n * F.lit(0.95))


def rank_place(n: Column) -> Column:
    """int(0.95 n) - 1; the last place if that is before the first."""
    k = F.floor(n * F.lit(0.95)) - 1
    return F.when(k < 0, n - 1).otherwise(k)


def _at(values: Column, place: Column) -> Column:
    return F.get(F.array_sort(values), place.cast("int"))


def nearest(values: Column, q: float) -> Column:
    """Array of bounded size: the sorted value at ``nearest_place``; 0 when empty."""
    n = F.size(values)
    return F.when(n > 0, _at(values, nearest_place(n, q))).otherwise(0)


def p95_floor(values: Column) -> Column:
    """Array of bounded size: the sorted value at ``floor_place``; 0 when empty."""
    n = F.size(values)
    return F.when(n > 0, _at(values, floor_place(n))).otherwise(0)


def p95_rank(values: Column) -> Column:
    """Array of bounded size: the sorted value at ``rank_place``; null when empty."""
    n = F.size(values)
    return F.when(n > 0, _at(values, rank_place(n)))


#: Ranges that a table without keys is cut into.
RANGES = 200


def values_at(rows: DataFrame, value: str, places: dict[str, Callable[[Column], Column]], keys: list[str] | None = None) -> DataFrame:
    """One row for each of ``keys``: the sorted value at each place, given by the number of values.

    Equal values are counted first. Without keys, the counts are added up by
    ranges of the value (their bounds come from its quantiles), so that no task
    sorts all of them. Null values are left out; no rows give no row.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*(keys or []), F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    if keys:
        w = Window.partitionBy(*keys)
        run = counts.select(*keys, "__v", F.sum("__n").over(w.orderBy("__v")).alias("__upto"), F.sum("__n").over(w).alias("__all"))
    else:
        cuts = counts.agg(F.percentile_approx("__v", F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), F.lit(10000)).alias("__cuts"))
        dealt = counts.join(F.broadcast(cuts)).withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col("__v")))).drop("__cuts")  # one row
        sums = dealt.groupBy("__range").agg(F.sum("__n").alias("__size"))
        # RANGES rows at most.
        before = sums.select("__range", (F.sum("__size").over(Window.orderBy("__range")) - F.col("__size")).alias("__before"), F.sum("__size").over(Window.partitionBy()).alias("__all"))
        inside = F.sum("__n").over(Window.partitionBy("__range").orderBy("__v"))
        run = dealt.withColumn("__inside", inside).join(F.broadcast(before), "__range").withColumn("__upto", F.col("__inside") + F.col("__before"))
    return run.groupBy(*(keys or [])).agg(*[F.min(F.when(F.col("__upto") > place(F.col("__all")), F.col("__v"))).alias(name) for name, place in places.items()])


def clamped(c: Column, default: float = 0.5) -> Column:
    """A number in [0, 1]; the default where it is none."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c.try_cast("double"), F.lit(default))))
