"""Running values over the ordered rows of a key, whatever the key's size.

A window function takes all rows of a key into one task. Here the rows are
range-partitioned by key and order, so that a large key is cut at sampled places
into slices of about ``SLICE_ROWS`` rows. Each slice works out its running values by
itself and is summed up by one row for each of its keys; the sums are scanned in
the order of the slices, and what lies before a slice is joined back to its rows.
No task holds more rows of a key than a slice, and the scan of the sums sees one
row for each slice of a key.

Orders must be total (end them with an id), nulls come first, and null keys are one key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

SLICE_ROWS = 1_000_000
SLICE = "__slice"


@dataclass(frozen=True)
class Running:
    """A running value: ``kind`` is count (of true values), sum, max, min or last (not null); ``before``: without the row itself."""

    kind: str
    value: Column
    before: bool = False


def sliced(rows: DataFrame, key: list[str], order: list[str], slice_rows: int | None = None) -> DataFrame:
    """The rows with the number of their slice, written; slices of a key are numbered in its order."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-rows.count() // (slice_rows or SLICE_ROWS)))
    return written(rows.repartitionByRange(parts, *key, *order).withColumn(SLICE, F.spark_partition_id()), "slices")


def running(rows: DataFrame, key: list[str], order: list[str], values: dict[str, Running]) -> DataFrame:
    """Sliced rows with a column for each running value; counts and sums begin at 0, the others at null."""
    here = Window.partitionBy(*key, SLICE).orderBy(*order)
    upto, strictly = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*[f"__k{i}" for i in range(len(key))]).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    inside, sums, before = {}, {}, {}
    for name, r in values.items():
        w = strictly if r.before else upto
        value = r.value.cast("long") if r.kind == "count" else r.value
        if r.kind in ("count", "sum"):
            inside[f"__in_{name}"], sums[f"__of_{name}"], before[f"__b_{name}"] = F.sum(value).over(w), F.sum(value), F.sum(f"__of_{name}").over(earlier)
        elif r.kind == "last":
            at = F.struct(*order)
            inside[f"__in_{name}"], sums[f"__of_{name}"] = F.last(value, ignorenulls=True).over(w), F.max_by(value, F.when(value.isNotNull(), at))
            before[f"__b_{name}"] = F.last(f"__of_{name}", ignorenulls=True).over(earlier)
        else:
            f = {"max": F.max, "min": F.min}[r.kind]
            inside[f"__in_{name}"], sums[f"__of_{name}"], before[f"__b_{name}"] = f(value).over(w), f(value), f(f"__of_{name}").over(earlier)
    named = [F.col(c).alias(f"__k{i}") for i, c in enumerate(key)]
    totals = rows.groupBy(*named, F.col(SLICE).alias("__s")).agg(*[c.alias(n) for n, c in sums.items()])
    carried = totals.select(*[f"__k{i}" for i in range(len(key))], "__s", *[c.alias(n) for n, c in before.items()])
    same = F.col(SLICE) == F.col("__s")
    for i, c in enumerate(key):
        same &= F.col(c).eqNullSafe(F.col(f"__k{i}"))
    out = rows.withColumns(inside).join(carried, same)
    both = {}
    for name, r in values.items():
        own, past = F.col(f"__in_{name}"), F.col(f"__b_{name}")
        if r.kind in ("count", "sum"):
            both[name] = F.coalesce(past, F.lit(0)) + F.coalesce(own, F.lit(0))
        elif r.kind == "last":
            both[name] = F.coalesce(own, past)
        else:
            both[name] = (F.greatest if r.kind == "max" else F.least)(own, past)
    return out.select(*rows.columns, *[c.alias(n) for n, c in both.items()])


def scan(rows: DataFrame, key: list[str], order: list[str], values: dict[str, Running], slice_rows: int | None = None) -> DataFrame:
    """The rows with their running values."""
    return running(sliced(rows, key, order, slice_rows), key, order, values).drop(SLICE)


def counted_within(rows: DataFrame, key: list[str], at: str, span: int, what: Column, out: str, slice_rows: int | None = None) -> DataFrame:
    """Add ``out``: how many rows of the key have ``what`` and lie in the ``span`` up to the row's place, both ends included.

    ``at``: a whole number. The count is the difference of two running counts: of
    rows up to the place, and of rows before the span. Each row looks both up by a
    mark of its own among the counted rows, so dense and sparse places cost the same.
    """
    numbered = written(rows.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    keys = [F.col(c) for c in key]
    part = lambda place, step, weight, row: numbered.select(*keys, place.alias("__at"), F.lit(step).alias("__step"), F.lit(weight).alias("__weight"), row.alias("__row"))
    here = F.col(at)
    marks = part(here, 2, 0, F.col("__row")).unionByName(part(here - span, 0, 0, F.col("__row")))
    counted = numbered.filter(what).select(*keys, here.alias("__at"), F.lit(1).alias("__step"), F.lit(1).alias("__weight"), F.col("__row"))
    found = scan(marks.unionByName(counted), key, ["__at", "__step", "__row"], {"__n": Running("sum", F.col("__weight"))}, slice_rows)
    sign = F.when(F.col("__step") == 2, F.col("__n")).otherwise(-F.col("__n"))
    counts = found.filter("__step <> 1").groupBy("__row").agg(F.sum(sign).alias(out))
    return numbered.join(counts, "__row").drop("__row")
