"""The inverted file gives the rows of a full scan."""

import numpy as np
import pytest

from lodestack.operators import vector_lists

FIELDS = "id long, grp string, content string, embedding array<double>"


def full_scan(rows, queries, k, farthest=None):
    out = []
    for q, g, v in queries:
        if not v:
            continue
        best = {}
        for i, grp, content, e in rows:
            if grp != g or not e:
                continue
            n = np.linalg.norm(e) * np.linalg.norm(v)
            d = round(1 - (float(np.dot(e, v) / n) if n else 0.0), 6) + 0.0
            if farthest is None or d <= farthest:
                best[content] = min(best.get(content, (9, 0)), (d, i))
        out += [(q, i, d, n + 1) for n, (d, i) in enumerate(sorted(best.values())[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (25, 6))
    made = [(i, "a" if i % 3 else "b", f"c{i % 700}", (centres[i % 25] + rng.normal(0, 0.05, 6)).round(4).tolist()) for i in range(2000)]
    made += [(3000 + i, "a", f"same{i % 4}", made[1][3]) for i in range(60)]  # copies of one vector
    return made + [(4000, "a", "null", None), (4001, "a", "zero", [0.0] * 6), (4002, "b", "empty", []), (4003, "alone", "x", made[0][3])]


QUERIES_OF = [0, 1, 2, 17, 33, 500, 1999]


def asked(rows):
    q = [(i, rows[i][1], rows[i][3]) for i in QUERIES_OF]
    return q + [(9000, "a", [0.0] * 6), (9001, "a", None), (9002, "nobody", rows[0][3]), (9003, "alone", rows[5][3]), (9004, "b", [-x for x in rows[3][3]])]


@pytest.mark.parametrize("farthest", [None, 0.4, 0.001])
def test_exact(spark, rows, farthest):
    index = vector_lists.build(spark.createDataFrame(rows, FIELDS), block_rows=50)
    q = spark.createDataFrame(asked(rows), "query_id long, grp string, embedding array<double>")
    found, reads = vector_lists.searched(index, q, 5, farthest)
    assert sorted((r.query_id, r.id, r.distance, r.rank) for r in found.collect()) == full_scan(rows, asked(rows), 5, farthest)
    n = {r.query_id: (r.lists, r.read) for r in reads.collect()}
    assert all(read < 0.5 * lists for i, (lists, read) in n.items() if i in QUERIES_OF)  # most lists stay closed
    index.drop()


def test_probes_and_shuffled_queries(spark, rows, monkeypatch):
    monkeypatch.setattr(vector_lists, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(vector_lists, "QUERY_ROWS", 2)
    index = vector_lists.build(spark.createDataFrame(rows, FIELDS))
    near = [x for x in asked(rows) if x[0] in QUERIES_OF]
    q = spark.createDataFrame(near, "query_id long, grp string, embedding array<double>")
    want = full_scan(rows, near, 5)
    assert sorted((r.query_id, r.id, r.distance, r.rank) for r in vector_lists.search(index, q).collect()) == want
    few, reads = vector_lists.searched(index, q, probes=4)
    assert {r.read for r in reads.collect()} == {4}
    hit = {(r.query_id, r.id) for r in few.collect()} & {(r[0], r[1]) for r in want}
    assert len(hit) >= 0.9 * len(want)


def test_empty(spark):
    none = vector_lists.build(spark.createDataFrame([], FIELDS))
    q = spark.createDataFrame([(1, "a", [1.0])], "query_id long, grp string, embedding array<double>")
    assert vector_lists.search(none, q).count() == 0
    zeros = vector_lists.build(spark.createDataFrame([(1, "a", "x", [0.0])], FIELDS))
    assert [(r.id, r.distance) for r in vector_lists.search(zeros, q).collect()] == [(1, 1.0)]
