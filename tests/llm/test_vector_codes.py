import hashlib
import math
import random

import numpy as np
import pytest

from lodestack.llm import vector_codes


def brute_force(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Plain lists of integers; rows: (id, vector)."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept)[:entries]
    books = [[cut(v, p) for _, v in first] for p in range(parts)]

    def near(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            of = [near(v, p)[1] for _, v in kept]
            book = []
            for k, e in enumerate(books[p]):
                own = [cut(v, p) for (_, v), c in zip(kept, of) if c == k]
                book.append([sum(x) // len(own) for x in zip(*own)] if own else e)
            new.append(book)
        books = new
    coded = [(i, "".join(f"{near(v, p)[1]:02x}" for p in range(parts)), sum(near(v, p)[0] for p in range(parts))) for i, v in kept]
    return coded, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_nearest_is_exact():
    rng = np.random.default_rng(1)
    for n, width, high in ((16, 8, 3), (5, 1, 4), (16, 8, 5000), (1, 4, 9), (30, 3, 1 << 26)):
        books = vector_codes.Codebooks(rng.integers(-high, high, (2, n, width)), 1.0)
        x = rng.integers(-high, high, (700, 2 * width))
        codes, d, looked = books.nearest(x)
        for p in range(2):
            full = ((x[:, None, p * width : (p + 1) * width] - books.entries[p][None]) ** 2).sum(2)
            assert (codes[:, p] == full.argmin(1)).all() and (d[:, p] == full.min(1)).all()
    spread = np.array([3, 900, 30, 1, 300, 9, 100, 2])  # taken from the widest on
    books = vector_codes.Codebooks(rng.integers(-1000, 1000, (8, 16, 8)) * spread, 1.0)
    assert books.nearest(rng.integers(-1000, 1000, (500, 64)) * np.tile(spread, 8))[2] < 0.3 * 500 * 64 * 16


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_against_brute_force(spark):
    """Ties, repeated rows, unused entries, nulls, other lengths and clashing columns."""
    rng = random.Random(2)
    vector = lambda: [rng.choice([-0.3, -0.1, 0.0, 0.00025, 0.2, 0.5]) for _ in range(16)]
    rows = [(i, vector(), rng.choice([0, 1, None])) for i in range(150)]
    rows += [(200 + i, rows[0][1], 1) for i in range(100)]  # copies of one vector
    bad = [(-1, None, 0), (-2, [None] * 16, 0), (-3, [float("nan")] + [0.0] * 15, 0), (-4, [float("inf")] + [0.0] * 15, 0), (-5, [], 0), (-6, [0.5] * 8, 0)]
    df = frame(spark, rows + bad).selectExpr("*", "'x' as code", "1 as error")
    books = vector_codes.fit(df)
    got = vector_codes.with_group_error(vector_codes.encode(df, books)).collect()
    coded, digest = brute_force([(r[0], list(np.float32(r[1]).astype(float))) for r in rows])
    assert books.digest() == digest
    assert sorted((r.vec_id, r.code, r.error) for r in got) == sorted(coded)
    labels = {r[0]: r[2] for r in rows}
    for r in got:
        assert r.label_error == sum(e for i, _, e in coded if labels[i] == r.label)
    back = {r.vec_id: r.decoded for r in vector_codes.decode(vector_codes.encode(df, books), books).collect()}
    for i, v, _ in rows[:20]:
        error = sum((math.floor(4096 * np.float32(a)) - (b * 4096 - 0.5)) ** 2 for a, b in zip(v, back[i]))
        assert error == pytest.approx(next(e for j, _, e in coded if j == i))


def test_small_tables(spark):
    none = frame(spark, [])
    assert vector_codes.encode(none, vector_codes.fit(none)).count() == 0
    df = frame(spark, [(3, [0.1] * 8, 1), (3, [0.0] * 8, 1), (None, [0.4] * 8, None), (3, [0.1] * 8, 1)])
    books = vector_codes.fit(df, rounds=0)
    assert books.entries[0].ravel().tolist() == [0, 409, 409]  # of equal ids the smaller vector, repeated rows count each
    got = vector_codes.encode(df, books).collect()
    assert sorted(r.code for r in got) == ["00" * 8, *["01" * 8] * 3] and sum(r.error for r in got) == 8 * (1638 - 409) ** 2
    with pytest.raises(Exception, match="must be below"):
        vector_codes.fit(frame(spark, [(1, [1e30] * 8, 1)]))


def test_query(spark, tiny):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tiny}/embeddings.parquet'")
    want = sorted(con.execute(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({vector_codes.ORACLE_SQL})").fetchall())
    got = vector_codes.query(spark, tiny)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 500
    rows = spark.read.parquet(f"{tiny}/embeddings.parquet").collect()
    coded, digest = brute_force([(r.vec_id, r.embedding) for r in rows])
    assert [(a, b, c) for a, b, c, _, _ in want] == sorted(coded) and want[0][4] == digest
