import random

import numpy as np
from pyspark.sql import functions as F

from lodestack.llm import near_dup as N


def test_signatures_estimate_the_weighted_similarity():
    rng = np.random.default_rng(5)
    items = N.mix(np.arange(60, dtype=np.uint64))
    a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
    b[:30] = a[:30]
    doc = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
    sig = N.bag_min_hash(doc, np.concatenate([items[a > 0], items[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, m=6000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def test_edges(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    rows = [(10, None), (11, ""), (12, " \n"), (13, "one two"), (14, "one  two"), (15, "two one"), (16, "a " * 3000), (17, "a " * 3000), (18, "a " * 2900), (19, "a " * 100), (20, " ".join(base)), (20, " ".join(base))]
    for k in range(25):
        t = list(base)
        for _ in range(k // 2):
            t[rng.randrange(len(t))] = "edit"
        rows.append((30 + k, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit(1), "bands": F.lit(2)})
    got = {r.doc_id: r.class_id for r in N.near_duplicates(df).collect()}
    assert got == N.brute_force(rows)
    assert N.near_duplicates(df.limit(0)).count() == 0
    assert N.near_duplicates(df.filter("doc_id in (10, 13)")).count() == 2
    assert N.near_duplicates(df).count() == len(rows)


def test_keep_first(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, "a"), (3, text + " x", "b"), (3, text + " x", "b"), (None, text, "c"), (7, None, "d"), (7, None, "d"), (8, "", "e"), (9, "other words here", "f"), (3, "again other words", "g"), (None, "lone", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, first string")
    got = sorted((str(r.doc_id), r.first) for r in N.keep_first(df).collect())
    assert got == sorted([("3", "b"), ("7", "d"), ("7", "d"), ("8", "e"), ("9", "f"), ("3", "g"), ("None", "h")])
    assert N.keep_first(df).columns == df.columns


def test_a_large_group_of_edited_copies(spark):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(260):
        t = list(base)
        for _ in range(rng.randrange(1, 9)):
            t[rng.randrange(len(t))] = f"e{rng.random()}"
        if k % 10 == 0:
            t = t[: rng.randrange(90, 150)]
        rows.append((k, " ".join(t)))
    for k in range(60):  # a second family, near the first
        t = [*base[:70], *(f"v{i}" for i in range(80))]
        for _ in range(rng.randrange(0, 6)):
            t[rng.randrange(len(t))] = f"e{rng.random()}"
        rows.append((1000 + k, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in N.near_duplicates(df).collect()}
    assert got == N.brute_force(rows)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in N.query(spark, d).collect()}
    want = N.brute_force(docs)
    assert got == want and len(set(want.values())) < len(docs)
