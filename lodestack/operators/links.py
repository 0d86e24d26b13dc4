"""Rows that may have to do with each other: components of the graph of near vectors.

Blocks of an inverted file are compared in pairs, but only those that the triangle
inequality does not keep apart. Blocks that follow each other are a strip, and pairs
of strips go to tasks: a block goes along once for each pair of its strip, not once
for each pair of its own. A pair gives no list of all its links, but a forest that
connects the same rows: as many edges at most as it has rows, however dense a
cluster is. Stars of the smallest ids then spread over the edges (each round
makes every tree at least half as high) until nothing changes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import dropped, written
from . import vector_lists

#: What rounding may do to a cosine.
SLACK = 1e-8
#: Blocks are compared by strips of so many bytes, of which a task holds two.
STRIP_BYTES, MOST_TASKS = 16 << 20, 1000


def roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Of each of n nodes the smallest that the edges (i, j) connect it to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges (node, root) that connect what a matrix of rows x columns connects; columns are numbered behind the rows."""
    i, j = np.nonzero(near)
    return [(k, int(r)) for k, r in enumerate(roots(i, j + near.shape[0], sum(near.shape))) if r != k]


def _linked(held: dict[int, tuple[np.ndarray, np.ndarray]], tests: list[tuple[int, int]], nearest: float) -> pd.DataFrame:
    """(one, two): edges that connect what the tested pairs of the held blocks (ids, vectors) connect."""
    first, n = {}, 0
    for b, (ids, _) in held.items():
        first[b], n = n, n + len(ids)
    found = [np.zeros((0, 2), np.int64)]
    for a, b in tests:
        (_, x), (_, y) = held[a], held[b]
        near = x @ y.T >= nearest - SLACK
        if near.any() and (pairs := forest(near)):
            local = np.array(pairs)
            found.append(np.where(local < len(x), local + first[a], local - len(x) + first[b]))
    i, j = np.concatenate(found).T
    root = roots(i, j, n)
    names = np.concatenate([ids for ids, _ in held.values()])
    moved = np.flatnonzero(root != np.arange(n))
    return pd.DataFrame({"one": names[moved], "two": names[root[moved]]})


def edges(rows: DataFrame, nearest: float, block_rows: int = vector_lists.BLOCK_ROWS) -> DataFrame:
    """(one, two): ids of ``rows`` (id, grp, embedding) that connect all rows of a group whose cosine is ``nearest`` or more."""
    spark = rows.sparkSession
    index = vector_lists.build(rows.withColumn("content", F.lit("")), block_rows=block_rows)
    kind = index.id_type.simpleString()
    blocks = written(index.blocks.filter("list >= 0").withColumn("block", F.monotonically_increasing_id()), "link-blocks")
    c = index.centroids
    apart = [(i, j, float(np.linalg.norm(c[i] - c[j]))) for i in range(len(c)) for j in range(len(c))]  # as many as lists, squared
    between = F.broadcast(spark.createDataFrame(apart, "la int, lb int, apart double"))
    reach = float(np.sqrt(max(0.0, 2 * (1 - nearest)))) + vector_lists.SLACK
    size = F.sum(F.length("rows")).over(Window.partitionBy("grp").orderBy("list", "lo", "block"))
    strip = written(blocks.select("grp", "list", "lo", "hi", "block", F.floor((size - 1) / STRIP_BYTES).alias("k")), "strips")
    side = lambda s: strip.select("grp", F.col("list").alias(f"l{s}"), F.col("lo").alias(f"lo{s}"), F.col("hi").alias(f"hi{s}"), F.col("k").alias(f"k{s}"), F.col("block").alias(s))
    met = side("a").join(side("b"), "grp").filter("a <= b").join(between, ["la", "lb"])
    gap = F.when(F.col("la") == F.col("lb"), F.greatest(F.col("lob") - F.col("hia"), F.col("loa") - F.col("hib"))).otherwise(F.col("apart") - F.col("hia") - F.col("hib"))
    near = met.filter(gap <= reach).groupBy("grp", F.least("ka", "kb").alias("k"), F.greatest("ka", "kb").alias("other")).agg(F.collect_list(F.struct("a", "b")).alias("t"))
    pairs = written(near.withColumn("pair", F.monotonically_increasing_id()), "strip-pairs")
    strips = strip.join(blocks.select("block", "rows"), "block").select("grp", "k", "block", "rows")
    wanted = pairs.select("pair", "grp", F.explode(F.array_distinct(F.array("k", "other"))).alias("k"))
    sent = wanted.join(strips, ["grp", "k"]).select("pair", "block", "rows", F.lit(None).cast("array<bigint>").alias("ones"), F.lit(None).cast("array<bigint>").alias("twos"))
    tests = pairs.select("pair", F.lit(-1).cast("bigint").alias("block"), F.lit(None).cast("binary").alias("rows"), F.col("t.a").alias("ones"), F.col("t.b").alias("twos"))

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, asked = {}, []
        for pdf in batches:
            for block, blob, ones, twos in zip(pdf["block"], pdf["rows"], pdf["ones"], pdf["twos"], strict=True):
                if block < 0:  # the first of its pair
                    if held:
                        yield _linked(held, asked, nearest)
                    held, asked = {}, list(zip(ones.tolist(), twos.tolist(), strict=True))
                else:
                    ids, _, _, x = pickle.loads(blob)
                    held[block] = (ids, x)
        if held:
            yield _linked(held, asked, nearest)

    dealt = tests.unionByName(sent).repartition(max(1, min(MOST_TASKS, pairs.count())), "pair").sortWithinPartitions("pair", "block")
    out = written(dealt.mapInPandas(link, f"one {kind}, two {kind}"), "links")
    index.drop()
    dropped(blocks, strip, pairs)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest id that each linked node is connected to."""
    ordered = lambda df: df.select(F.greatest("one", "two").alias("u"), F.least("one", "two").alias("v")).filter("u <> v").distinct()
    now, mark = written(ordered(links), "stars"), None
    while True:
        size = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if size == mark:
            break
        mark = size
        # Large stars: the larger neighbours of a node hang on the smallest of all.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition("u")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("one"), F.col("m").alias("two"))
        large = written(ordered(large), "stars")
        # Small stars: a node and its smaller neighbours hang on the smallest of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("one"), F.col("m").alias("two")).unionByName(least.select(F.col("u").alias("one"), F.col("m").alias("two")))
        after = written(ordered(small), "stars")
        dropped(now, large)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
