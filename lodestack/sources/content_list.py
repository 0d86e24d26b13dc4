"""Layout items from JSON files, one array for each document."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_text, _list = T.StringType(), T.ArrayType(T.StringType())
#: The fields of an item; unknown ones are ignored.
ITEM = T.StructType(
    [T.StructField("pos", T.IntegerType()), T.StructField("type", _text), T.StructField("text", _text), T.StructField("text_level", T.IntegerType()), T.StructField("page_idx", T.IntegerType())]
    + [T.StructField(c, _text) for c in ("img_path", "table_body", "code_body")]
    + [T.StructField(c, _list) for c in ("image_caption", "chart_caption", "table_caption", "image_footnote", "chart_footnote", "table_footnote", "list_items", "code_caption")]
)
LEAST_BYTES = 10


def discovered(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Files in folders named ``auto`` that end in ``_content_list.json``, without second versions; adds ``stem``."""
    stem = F.regexp_extract(F.col(path_col), r"/auto/([^/]*)_content_list\.json$", 1)
    return files.withColumn("stem", stem).filter((F.col("stem") != "") & ~F.col(path_col).contains("_v2"))


def parsed(rows: DataFrame, json_col: str) -> DataFrame:
    """Add ``items`` (null where there are none) and ``finding``: ``small``, ``broken`` or null."""
    raw = F.coalesce(F.col(json_col), F.lit(""))
    items = F.from_json(raw, T.ArrayType(ITEM), {"mode": "PERMISSIVE"})
    whole = raw.rlike(r"(?s)^\s*\[.*\]\s*$") & F.try_parse_json(raw).isNotNull()
    out = rows.withColumn("finding", F.when(F.octet_length(raw) < LEAST_BYTES, "small").when(~whole, "broken"))
    return out.withColumn("items", F.when(F.col("finding").isNull(), items))


def write(files: DataFrame, root: str) -> int:
    """Write a file for each row (path below the root, json); gives their number. A file that is there is replaced.

    Tasks write them, by Arrow's file systems, so the root must be one that these open.
    """
    pafs.FileSystem.from_uri(root)  # an unknown scheme fails here

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(root)
        for pdf in batches:
            for path, text in zip(pdf["path"], pdf["json"], strict=True):
                fs.create_dir(f"{base}/{path}".rsplit("/", 1)[0])
                with fs.open_output_stream(f"{base}/{path}") as f:
                    f.write((text or "").encode())
            yield pd.DataFrame({"n": [len(pdf)]})

    return files.select("path", "json").mapInPandas(put, "n bigint").agg(F.sum("n")).first()[0] or 0


def read(spark: SparkSession, root: str) -> DataFrame:
    """(path, stem, items, finding) of all documents below a folder."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*_content_list.json").option("wholetext", True).text(root)
    named = files.withColumn("path", F.col("_metadata.file_path"))
    return parsed(discovered(named), "value").select("path", "stem", "items", "finding")


def items(documents: DataFrame) -> DataFrame:
    """One row for each item, in order."""
    return documents.select("stem", F.posexplode("items").alias("pos", "item")).select("stem", "pos", *[F.col(f"item.{f.name}") for f in ITEM if f.name != "pos"])
