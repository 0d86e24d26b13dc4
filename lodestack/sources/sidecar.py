"""Small side tables (loaded stems, content digests) and append-only logs, as JSON lines."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows of JSON lines; a missing path has none, and broken lines are left out."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    try:
        raw = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kind)
    return parsed(raw, kind)


def parsed(lines: DataFrame, schema: T.StructType | str) -> DataFrame:
    """The rows of JSON lines (value) that are whole objects."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    good = F.try_parse_json(F.col("value")).isNotNull() & F.col("value").rlike(r"^\s*\{")
    return lines.filter(good).select(F.from_json("value", kind).alias("r")).select("r.*")


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(F.try_parse_json(F.col("value")).isNull())


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def facts(column: str) -> F.col:
    """Fact groups from a JSON text that holds a list of lists, a list of words or one word."""
    raw = F.col(column)
    nested, flat = F.from_json(raw, "array<array<string>>"), F.from_json(raw, "array<string>")
    one = F.when(F.trim(raw) != "", F.array(F.array(raw)))
    return F.when(raw.rlike(r"^\s*\[\s*\["), nested).when(raw.rlike(r"^\s*\["), F.transform(flat, lambda x: F.array(x))).otherwise(F.coalesce(one, F.array().cast("array<array<string>>")))
