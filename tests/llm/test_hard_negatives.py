import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import hard_negatives


def brute_force(rows, is_anchor, k=5):
    """rows: (id, label, vector); plain loops over all pairs."""
    dims = max({len(v) for i, la, v in rows if v}, key=lambda n: sum(len(v) == n for _, _, v in rows if v)) if rows else 0
    kept = [(i, la, [math.floor(256 * x) for x in v]) for i, la, v in rows if i is not None and la is not None and v and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in sorted({i for i, _, _ in kept if is_anchor(i)}):
        _, label, q = min(x for x in kept if x[0] == a)
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, la) for i, la, v in kept if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:k]:
            fit = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(fit)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")


def test_small_blocks_and_bad_rows(spark, monkeypatch):
    """Many blocks and cells, ties, copies, nulls, repeated ids, negative scores, another length."""
    rng = random.Random(4)
    vector = lambda: [rng.choice([-0.3, -0.1, 0.0, 0.125, 0.2, 0.5]) for _ in range(6)]
    rows = [(i, rng.randrange(3), vector()) for i in range(260)]
    rows += [(300 + i, i % 2, rows[0][2]) for i in range(120)]  # copies of one vector
    rows += [(0, 1, vector()), (7, 1, rows[7][2]), (20, 0, rows[3][2])]  # repeated ids
    rows += [(600, 1, None), (601, None, vector()), (602, 1, [None] * 6), (603, 1, [float("nan")] * 6), (604, 1, []), (None, 1, vector()), (605, 1, [0.1] * 4), (620, 2, [-0.5] * 6)]
    df = frame(spark, rows).selectExpr("*", "1 as slot", "'x' as pivot")
    index = hard_negatives.build(df, pivots=4, block_rows=16, cell_rows=30)
    assert index.blocks.count() > 20 and index.blocks.select("pivot", "cell").distinct().count() > 6
    monkeypatch.setattr(hard_negatives, "QUERY_ROWS", 7)
    got = hard_negatives.mine(df, F.col("vec_id") % 20 == 0, index=index)
    want = brute_force(rows, lambda i: i % 20 == 0)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_annuli_are_skipped(spark):
    """On vectors in clusters most rows are never scored, and the result is that of all pairs; so it is with blocks that are shuffled."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (12, 8))
    rows = [(i, int(rng.integers(2)), (centres[i % 12] + rng.normal(0, 0.02, 8)).tolist()) for i in range(3000)]
    df = frame(spark, rows)
    scored = spark.sparkContext.accumulator(0)
    got = sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 500 == 0, scored=scored).collect()))
    assert scored.value < 0.5 * 2 * 6 * 3000
    asked = {i for i, _, _ in rows if i % 500 == 0}
    exact = [(i, la, np.floor(256 * np.float32(v).astype(float)).astype(int)) for i, la, v in rows]
    for a in asked:
        _, label, q = exact[a]
        s = sorted((-int(q @ v), i, la) for i, la, v in exact if i != a)
        near = [(i, -t) for t, i, la in s if la == label][:5]
        assert list(dict.fromkeys((r[1], r[4]) for r in sorted(got, key=lambda r: (-r[4], r[1])) if r[0] == a)) == [x for x in near if any(-t <= x[1] and -10 * t >= 8 * x[1] for t, _, la in s if la != label)]
        for p, ps in near:
            assert [(r[3], r[5]) for r in got if r[0] == a and r[1] == p] == [(i, -t) for t, i, la in s if la != label and 80 * ps <= -100 * t <= 100 * ps][:5]


def test_no_broadcast(spark, tiny, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, hard_negatives.query(spark, tiny).collect())) == oracle(tiny)


def oracle(tiny):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tiny}/embeddings.parquet'")
    return sorted(con.execute(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({hard_negatives.ORACLE_SQL})").fetchall())


def test_query(spark, tiny):
    got = hard_negatives.query(spark, tiny)
    assert sorted(map(tuple, got.collect())) == oracle(tiny)
    rows = [(r.vec_id, (r.label + (r.vec_id % 7 == 0)) % 10, r.embedding) for r in spark.read.parquet(f"{tiny}/embeddings.parquet").collect()]
    assert oracle(tiny) == brute_force(rows, lambda i: i % 100 == 0)


def test_empty(spark):
    assert hard_negatives.mine(frame(spark, []), F.col("vec_id") % 2 == 0).count() == 0
    one = frame(spark, [(0, 1, [0.5]), (1, 1, [0.5])])
    assert hard_negatives.mine(one, F.col("vec_id") == 0).count() == 0
    assert hard_negatives.mine(one, F.col("vec_id") == 9).count() == 0
    zero = frame(spark, [(0, 1, [0.0]), (1, 1, [0.0]), (2, 2, [0.0])])
    assert [tuple(r) for r in hard_negatives.mine(zero, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2, 0, 0)]
    with pytest.raises(Exception, match="must be below"):
        hard_negatives.build(frame(spark, [(0, 1, [1e30])]))
