"""Components of near vectors, and the ordered merge over them."""

import random

import numpy as np
import pytest

from lodestack.operators import links, memory


def test_forest():
    rng = np.random.default_rng(1)
    for _ in range(50):
        near = rng.random((7, 9)) < 0.12
        parent = list(range(16))

        def root(k):
            while parent[k] != k:
                k = parent[k]
            return k

        for i, j in zip(*np.nonzero(near)):
            parent[max(root(i), root(j + 7))] = min(root(i), root(j + 7))
        got = links.forest(near)
        assert {k: r for k, r in got} == {k: root(k) for k in range(16) if root(k) != k} and len(got) < 16


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(500, 300), (400, 300), (7, 7)]
    parent = {k: k for p in pairs for k in p}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in links.components(spark.createDataFrame(pairs, "one long, two long")).collect()}
    assert got == {k: root(k) for k in parent if root(k) != k}
    assert links.components(spark.createDataFrame([], "one long, two long")).count() == 0


def one_by_one(rows, nearest):
    """Every memory against every kept one of its group, in the order of id."""
    kept, out = {}, {}
    for i, user, category, v in sorted(rows):
        x = None if not v or not np.linalg.norm(v) else np.asarray(v) / np.linalg.norm(v)
        slots = kept.setdefault((user, category), [])
        sims = [round(float(s[1] @ x), 9) for s in slots] if x is not None else []
        hit = int(np.argmax(sims)) if sims and max(sims) >= nearest else None
        if x is None:
            out[i] = i
        elif hit is None:
            slots.append([i, x])
            out[i] = i
        else:
            slots[hit][1] = x
            out[i] = slots[hit][0]
    return out


@pytest.mark.parametrize("nearest", [0.9, 0.97])
def test_one_label_holds_all_rows(spark, monkeypatch, nearest):
    """Clusters, chains, copies and rows without a vector, in small blocks: the rows of the plain merge, in many parts."""
    build = links.vector_lists.build
    monkeypatch.setattr(links.vector_lists, "build", lambda rows, **k: build(rows, lists=12, block_rows=20))
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (40, 7))
    rows = [(i, "u", "fact", (centres[rng.integers(40)] + rng.normal(0, 0.22, 7)).tolist()) for i in range(400)]
    rows += [(1000 + i, "u", "fact", rows[3][3]) for i in range(80)] + [(2000, "u", "fact", None), (2001, "u", "fact", [0.0] * 7), (2002, None, "fact", rows[3][3]), (2003, "u", None, rows[3][3])]
    df = spark.createDataFrame(rows, "id long, username string, category string, embedding array<double>")
    got = {r.id: r.into for r in memory.semantic_groups(df, nearest).collect()}
    assert got == one_by_one(rows, nearest)
    near = links.components(links.edges(df.selectExpr("id", "'g' as grp", "embedding"), nearest))
    sizes = [r["count"] for r in near.groupBy("component").count().collect()]
    assert len(sizes) > 5 and max(sizes) < 400


def test_strips_link_what_all_pairs_link(spark, monkeypatch):
    """Several strips a group, several blocks a strip."""
    rng = np.random.default_rng(5)
    around = rng.normal(size=(40, 8))
    x = np.concatenate((around[rng.integers(0, 40, 300)] + rng.normal(size=(300, 8)) * 0.15, rng.normal(size=(100, 8))))
    rows = [(i, "gh"[i % 2], v.tolist()) for i, v in enumerate(x)]
    parent = list(range(len(x)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for a, b in zip(*np.nonzero(unit @ unit.T >= 0.9)):
        if a % 2 == b % 2:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    monkeypatch.setattr(links, "STRIP_BYTES", 4000)
    near = links.edges(spark.createDataFrame(rows, "id long, grp string, embedding array<double>"), 0.9, block_rows=7)
    got = {r.node: r.component for r in links.components(near).collect()}
    assert got == {k: root(k) for k in range(len(x)) if root(k) != k} and len(got) > 100


def test_blocks_are_not_shuffled_for_each_pair(spark):
    """without clusters all blocks of a group are compared, but they go along by strips."""
    x = np.random.default_rng(6).normal(size=(2000, 16))
    df = spark.createDataFrame([(i, "g", v.tolist()) for i, v in enumerate(x)], "id long, grp string, embedding array<double>")
    sc, name = spark.sparkContext._jsc.sc(), "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)

    def shuffled():
        sc.listenerBus().waitUntilEmpty()
        return sum(sc.statusStore().executorList(False).apply(k).totalShuffleWrite() for k in range(sc.statusStore().executorList(False).size()))

    try:
        spark.conf.set(name, "-1")
        began = shuffled()
        links.edges(df, 0.9, block_rows=20)
        assert 0 < shuffled() - began < 12 * x.nbytes
    finally:
        spark.conf.set(name, before)
