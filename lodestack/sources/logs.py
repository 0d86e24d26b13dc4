"""Multi-line log blocks and the sessions they form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEADER = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(thread_id, at, line): a file is a thread, a line's place its order.

    Blocks need the lines of a file in order, so files are read whole; log files
    are rolled, so a file has a bounded size.
    """
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("thread_id"), "value")
    return files.select("thread_id", F.posexplode(F.split("value", "\n")).alias("at", "line"))


def blocks(lines: DataFrame) -> DataFrame:
    """A block starts at a line with a time stamp and takes the lines after it; lines before the first are left out."""
    w = Window.partitionBy("thread_id").orderBy("at")
    rows = lines.withColumn("block", F.count_if(F.col("line").rlike(HEADER)).over(w)).filter("block > 0")
    g = rows.groupBy("thread_id", "block").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return g.select("thread_id", "block", text.alias("text"), F.to_timestamp(F.regexp_extract(text, HEADER, 1), "yyyy-MM-dd HH:mm:ss").alias("ts"))


def sessions(rows: DataFrame, patterns: dict[str, str], other: str = "other") -> DataFrame:
    """(thread_id, category, first, last, n): the category is the first pattern that a block matches."""
    category = F.lit(other)
    for name, pattern in reversed(patterns.items()):
        category = F.when(F.col("text").rlike(pattern), name).otherwise(category)
    return rows.groupBy("thread_id", category.alias("category")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
