"""Incremental load: which documents are new, which are copies, and how tables change."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import not_zero


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key by the order (newest first)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Old rows whose keys are not in the new ones, and the last new row of each key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(latest(new, keys, *order))


def guarded_upsert(old: DataFrame, new: DataFrame, key: str, owner: str) -> DataFrame:
    """Replace rows by key only where the owner is the same; other incoming rows with a known key are dropped."""
    known = old.select(key, F.col(owner).alias("__owner"))
    allowed = new.join(known, key, "left").filter(F.col("__owner").isNull() | (F.col("__owner") == F.col(owner))).drop("__owner")
    return old.join(allowed.select(key), key, "left_anti").unionByName(allowed)


def replaced_documents(old: DataFrame, new: DataFrame, stem: str = "source_stem") -> DataFrame:
    """All rows of the new rows' documents give way to them."""
    return old.join(new.select(stem).distinct(), stem, "left_anti").unionByName(new)


def plan_jobs(jobs: DataFrame, done: DataFrame, kept: DataFrame, force: bool = False) -> DataFrame:
    """What happens to each job (stem, md5): ``done``, ``copy`` with the stem it repeats, or ``load``.

    ``done``: loaded stems. ``kept``: (md5, kept_stem) of loaded contents. Of new
    stems with the same content the first is loaded; no md5 means no comparison.
    """
    if force:
        return jobs.select("stem", F.lit("load").alias("action"), F.lit(None).cast("string").alias("copy_of"))
    rows = jobs.join(done.select("stem", F.lit(True).alias("__done")), "stem", "left").join(kept, "md5", "left")
    fresh = rows.filter("__done is null and md5 is not null and kept_stem is null")
    firsts = fresh.groupBy("md5").agg(F.min("stem").alias("__first"))
    rows = rows.join(firsts, "md5", "left")
    original = F.coalesce("kept_stem", "__first")
    copy = original.isNotNull() & (original != F.col("stem"))
    action = F.when(F.col("__done"), "done").when(copy, "copy").otherwise("load")
    return rows.select("stem", action.alias("action"), F.when(action == "copy", original).alias("copy_of"))


def split_plan(files: DataFrame, pages_limit: int = 500, size_limit: float = 70.0, part_size: float = 25.0) -> DataFrame:
    """(stem, part, first, last): page ranges of large files; files (stem, pages, mib).

    More pages than the limit are split by it, a larger size by the mean size of
    a page, with 10 to ``pages_limit`` pages a part; other files are one part.
    """
    per = F.when(F.col("mib") > size_limit, F.greatest(F.lit(10), F.least(F.lit(pages_limit), F.floor(part_size / (F.col("mib") / F.col("pages")))))).when(F.col("pages") > pages_limit, pages_limit).otherwise(F.col("pages"))
    rows = files.filter("pages > 0").withColumn("per", per.cast("int"))
    starts = rows.select("stem", "pages", "per", F.explode(F.sequence(F.lit(1), F.col("pages").cast("int"), F.col("per"))).alias("first"))
    return starts.select("stem", F.concat("stem", F.lit("_p"), F.col("first").cast("string"), F.lit("-"), F.least(F.col("first") + F.col("per") - 1, "pages").cast("string")).alias("part"), "first", F.least(F.col("first") + F.col("per") - 1, F.col("pages")).cast("int").alias("last"))


def covers_all(parts: DataFrame, files: DataFrame) -> DataFrame:
    """(stem, reusable): whether existing page ranges cover 1 to n exactly, none outside."""
    good = parts.join(files, "stem").groupBy("stem", "pages").agg(
        F.min((F.col("first") > 0) & (F.col("last") >= F.col("first")) & (F.col("last") <= F.col("pages"))).alias("valid"), F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("last") >= F.col("first"), F.sequence("first", "last")))))).alias("covered")
    )
    return good.select("stem", (F.col("valid") & (F.col("covered") == F.col("pages"))).alias("reusable"))


def text_points(chunks: DataFrame, fields: list[str], sparse: str = "sparse") -> DataFrame:
    """Payload columns and the sparse map as two parallel arrays, by token."""
    entries = F.array_sort(F.map_entries(sparse))
    return chunks.select(*fields, F.transform(entries, lambda e: e["key"]).alias("indices"), F.transform(entries, lambda e: e["value"]).alias("weights"))


def image_points(images: DataFrame, fields: list[str], vector: str = "dense") -> DataFrame:
    """Payload columns and the described text; vectors of zeros are left out."""
    described = F.trim(F.concat(F.trim(F.coalesce("caption", F.lit(""))), F.lit("\n"), F.trim(F.coalesce("description", F.lit("")))), F.lit(" \n"))
    return images.filter(not_zero(F.col(vector))).select(*fields, F.when(described == "", "[无描述]").otherwise(described).alias("desc_text"))


def capped_log(rows: DataFrame, key: str, order: str, cap: int) -> DataFrame:
    """A log over the cap loses its oldest half."""
    w = Window.partitionBy(key)
    n = F.count("*").over(w)
    place = F.row_number().over(w.orderBy(order))
    return rows.withColumns({"__n": n, "__p": place}).filter((F.col("__n") <= cap) | (F.col("__p") > F.floor(F.col("__n") / 2))).drop("__n", "__p")


def point_id():
    """A pandas UDF of the UUID (version 5, DNS name space) of a chunk id; for exports."""
    import uuid

    from pyspark.sql import types as T

    @F.pandas_udf(T.StringType())
    def uuid5(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else str(uuid.uuid5(uuid.NAMESPACE_DNS, x)))

    return uuid5
