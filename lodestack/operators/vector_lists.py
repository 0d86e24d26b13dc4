"""An inverted file of vectors: lists around coarse centroids, searched exactly.

Centroids are fitted on a bounded sample (the rows of the ``SAMPLE`` smallest
hashes of their ids); every row is in the list of its nearest centroid, stored
sorted by group, list and distance to the centroid, in blocks of ``BLOCK_ROWS``.

A search first reads, for each query, the lists nearest to it until they hold
``SEEDS`` times k rows of its group. The k-th distance found there bounds what is
left: by the triangle inequality a row is no nearer than the difference of the
query's and the row's distance to the row's centroid, so only blocks within the
bound are read, and the result is that of all rows. With ``probes`` only so many
lists are read and the result is approximate; its recall can be measured against
the exact one.

Distances are cosine distances with six decimals, ties go to the smaller id, and
of rows with equal content only the best counts. Vectors without length have
distance 1 to all and are in a list of their own, which is always read; a query
without length reads all lists. Rows and queries without a vector take no part.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import dropped, written

LISTS, SAMPLE, ROWS_A_LIST = 100, 16_384, 20
BLOCK_ROWS, QUERY_ROWS = 4096, 512
SEEDS = 4
BROADCAST_ROWS = 50_000
DIGITS = 6
#: More than rounding does to distances between unit vectors.
SLACK = 2e-6


@dataclass(frozen=True)
class VectorLists:
    """``blocks``: grp, list, lo, hi, n, rows. ``sizes``: grp, list, lo, hi, n."""

    blocks: DataFrame
    sizes: DataFrame
    centroids: np.ndarray
    id_type: T.DataType
    group_type: T.DataType

    def drop(self) -> None:
        dropped(self.blocks, self.sizes)


def _units(v: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack(v.to_numpy()).astype(np.float64)
    n = np.linalg.norm(x, axis=1)
    return np.divide(x, n[:, None], out=np.zeros_like(x), where=n[:, None] > 0), n


def _fit(x: np.ndarray, lists: int) -> np.ndarray:
    """Means of the sample's parts, from rows far from each other on."""
    chosen, nearest = [0], 1 - x @ x[0]
    while len(chosen) < lists and nearest.max() > SLACK:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, 1 - x @ x[chosen[-1]])
    c = x[chosen].copy()
    for _ in range(8):
        own = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (own == j).any() and (n := np.linalg.norm(m := x[own == j].mean(0))):
                c[j] = m / n
    return c


def build(rows: DataFrame, lists: int = LISTS, block_rows: int = BLOCK_ROWS) -> VectorLists:
    """Lists of (id, grp, content, embedding); groups are searched by themselves."""
    plain = rows.select("id", "grp", "content", "embedding").filter("embedding is not null and size(embedding) > 0")
    some = plain.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toPandas()  # of a fixed size
    centroids = np.zeros((0, 1))
    if len(some):
        x, n = _units(some["embedding"])
        if (n > 0).any():
            centroids = _fit(x[n > 0], max(1, min(lists, int((n > 0).sum()) // ROWS_A_LIST)))
    kinds = {f.name: f.dataType.simpleString() for f in plain.schema}
    fields = f"grp {kinds['grp']}, list int, r double, id {kinds['id']}, content {kinds['content']}, x binary"

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x, n = _units(pdf["embedding"])
            near = x @ centroids.T if len(centroids) else np.zeros((len(x), 1))
            own = np.where(n > 0, near.argmax(1), -1)
            r = np.where(n > 0, np.linalg.norm(x - centroids[own], axis=1), 0.0) if len(centroids) else np.zeros(len(x))
            yield pdf[["grp"]].assign(list=own.astype(np.int32), r=r, id=pdf["id"], content=pdf["content"], x=[v.tobytes() for v in x])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _runs(batches, ["grp", "list"], block_rows):
            x = np.frombuffer(b"".join(part["x"]), np.float64).reshape(len(part), -1)
            blob = pickle.dumps((part["id"].to_numpy(), part["content"].to_numpy(), part["r"].to_numpy(), x), protocol=5)
            yield pd.DataFrame({"grp": [part["grp"].iloc[0]], "list": [part["list"].iloc[0]], "lo": [part["r"].iloc[0]], "hi": [part["r"].iloc[-1]], "n": [len(part)], "rows": [blob]})

    order = ["grp", "list", "r", "id"]
    placed = plain.mapInPandas(assign, fields).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = written(placed.mapInPandas(pack, f"grp {kinds['grp']}, list int, lo double, hi double, n bigint, rows binary"), "vector-blocks")
    sizes = written(blocks.groupBy("grp", "list").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")), "vector-lists")
    return VectorLists(blocks, sizes, centroids, plain.schema["id"].dataType, plain.schema["grp"].dataType)


def _runs(batches: Iterator[pd.DataFrame], keys: list[str], most: int) -> Iterator[pd.DataFrame]:
    """Runs of equal keys, ``most`` rows at most each; runs that go on in the next batch are cut."""
    for pdf in batches:
        if not len(pdf):
            continue
        for _, run in pdf.groupby((pdf[keys] != pdf[keys].shift()).any(axis=1).cumsum(), sort=False):
            for a in range(0, len(run), most):
                yield run.iloc[a : a + most]


def _wanted(index: VectorLists, queries: DataFrame) -> DataFrame:
    """(query_id, grp, q, list, d, lo, hi, n): each query with the lists of its group, and its distance to their centroids."""
    centroids = index.centroids
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}
    fields = f"query_id {kinds['query_id']}, grp {kinds['grp']}, q binary, places array<double>"

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x, n = _units(pdf["embedding"])
            d = np.sqrt(np.maximum(2 - 2 * x @ centroids.T, 0)) if len(centroids) else np.zeros((len(x), 0))
            d[n == 0] = np.nan  # no bound holds
            yield pdf[["query_id", "grp"]].assign(q=[v.tobytes() for v in x], places=list(d))

    asked = queries.filter("embedding is not null and size(embedding) > 0").select("query_id", "grp", "embedding").mapInPandas(place, fields)
    d = F.when(F.col("list") >= 0, F.get("places", F.col("list")))
    return asked.join(index.sizes, "grp").select("query_id", "grp", "q", "list", F.when(~F.isnan(d), d).alias("d"), "lo", "hi", "n")


def _read(index: VectorLists, wanted: DataFrame, k: int, farthest: float | None) -> DataFrame:
    """(query_id, id, content, distance): the best k contents of each query in each block that is within its ``reach``."""
    kinds = {f.name: f.dataType.simpleString() for f in wanted.schema}

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _runs(batches, ["grp", "list"], QUERY_ROWS):
            d, reach = part["d"].fillna(0).to_numpy(), part["reach"].to_numpy()
            x = np.frombuffer(b"".join(part["q"]), np.float64).reshape(len(part), -1)
            yield pd.DataFrame({"grp": [part["grp"].iloc[0]], "list": [part["list"].iloc[0]], "from_r": [(d - reach).min()], "to_r": [(d + reach).max()], "asked": [pickle.dumps((part["query_id"].to_numpy(), d, reach, x), protocol=5)]})

    order = ["grp", "list", "d", "query_id"]
    packs = wanted.select("query_id", "grp", "q", "list", "d", "reach").repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(pack, f"grp {kinds['grp']}, list int, from_r double, to_r double, asked binary")
    packs = written(packs, "packed-queries")
    few = packs.count() * QUERY_ROWS <= BROADCAST_ROWS
    met = index.blocks.join(F.broadcast(packs) if few else packs, ["grp", "list"]).filter("lo <= to_r and hi >= from_r").select("rows", "asked")
    id_kind, content_kind = index.id_type.simpleString(), "string"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rows, asked in zip(pdf["rows"], pdf["asked"], strict=True):
                (ids, content, r, x), (query, d, reach, q) = pickle.loads(rows), pickle.loads(asked)
                distance = np.round(1 - x @ q.T, DIGITS) + 0.0
                out = []
                for j in range(len(query)):
                    near = np.flatnonzero(np.abs(r - d[j]) <= reach[j]) if np.isfinite(reach[j]) else np.arange(len(r))
                    if farthest is not None:
                        near = near[distance[near, j] <= farthest]
                    seen: set = set()
                    for i in near[np.lexsort((ids[near], distance[near, j]))]:
                        if content[i] not in seen:
                            seen.add(content[i])
                            out.append((query[j], ids[i], content[i], distance[i, j]))
                            if len(seen) == k:
                                break
                if out:
                    yield pd.DataFrame(out, columns=["query_id", "id", "content", "distance"])

    return met.mapInPandas(score, f"query_id {kinds['query_id']}, id {id_kind}, content {content_kind}, distance double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    once = found.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "content").orderBy("distance", "id"))).filter("__n = 1").drop("__n")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).filter(F.col("rank") <= k)


def search(index: VectorLists, queries: DataFrame, k: int = 5, farthest: float | None = None, probes: int | None = None) -> DataFrame:
    """(query_id, id, content, distance, rank): the k nearest rows of each query's group, of distinct contents.

    ``queries``: query_id, grp, embedding.
    """
    found, _ = searched(index, queries, k, farthest, probes)
    return found


def searched(index: VectorLists, queries: DataFrame, k: int = 5, farthest: float | None = None, probes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """As ``search``, and (query_id, lists, read): how many lists a query's group has, and how many were looked into."""
    wanted = written(_wanted(index, queries), "wanted-lists")
    near = Window.partitionBy("query_id").orderBy(F.coalesce("d", F.lit(0.0)), "list")
    before = F.coalesce(F.sum("n").over(near.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The list of vectors without length and the lists of such a query have no bound.
    bound = F.when(F.col("d").isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.col("d") - F.col("hi"), F.col("lo") - F.col("d")))
    placed = wanted.withColumns({"before": before, "place": F.row_number().over(near), "bound": bound})
    now = (F.col("place") <= probes) if probes else (F.col("before") < SEEDS * k) | F.col("d").isNull()
    placed = written(placed.withColumn("first", now), "ordered-lists")
    first = placed.filter("first").withColumn("reach", F.lit(float("inf")))
    found = written(_read(index, first, k, farthest), "found")
    counts = placed.groupBy("query_id").agg(F.count("*").alias("lists"), F.count_if("first").alias("read"))
    if probes:
        return _ranked(found, k), counts
    kth = _ranked(found, k).groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("distance"))).alias("kth"))
    most = F.lit(2.0 if farthest is None else float(farthest))
    # A row at cosine distance t lies at distance sqrt(2 t) from the query.
    limit = F.sqrt(2 * (F.least(F.coalesce("kth", most), most) + SLACK)) + SLACK
    rest = written(placed.filter("not first").join(kth, "query_id", "left").withColumn("reach", limit).filter(F.col("bound") <= F.col("reach")), "other-lists")
    more = _read(index, rest, k, farthest)
    later = rest.groupBy("query_id").agg(F.count("*").alias("later"))
    reads = counts.join(later, "query_id", "left").select("query_id", "lists", (F.col("read") + F.coalesce("later", F.lit(0))).alias("read"))
    return _ranked(found.unionByName(more), k), reads
