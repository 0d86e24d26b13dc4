import math

import pytest
from pyspark.sql import functions as F

from lodestack.llm import language_model as M

ROWS = [
    (1, "The cat sat on the mat. THE END", True), (2, None, True), (3, "", True), (4, "über allen Gipfeln ist Ruh", False), (5, "the cat sat", False), (5, "the cat sat", False),
    (6, "zz\x00 \t\nqq", None), (7, "the the the " * 300, True), (8, "日本", False), (9, "a", True),
]


def test_like_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, learn boolean").withColumns({"n_tokens": F.lit(1), "block": F.lit(2), "packed": F.lit(3)}).repartition(3)
    want = sorted((r[0], *b) for r, b in zip(ROWS, M.brute_force([(t, bool(x)) for _, t, x in ROWS])))
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in M.score(df).collect())
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert g[4:] == pytest.approx(w[4:], rel=1e-9, abs=1e-9)


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "ab", False), (None, None, None)], "doc_id long, text string, learn boolean")
    got = {r.doc_id: r for r in M.score(df).collect()}
    assert got[1].score == pytest.approx(24 * math.log10(0.5)) and got[1].train_tokens == 0 and got[None].n_tokens == 1
    assert M.score(df.limit(0)).count() == 0


def test_query(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").collect()
    got = {r.doc_id: r for r in M.query(spark, tiny).collect()}
    import zlib

    short = [(d.text, zlib.crc32(str(d.doc_id).encode()) % 7 != 2) for d in docs]
    for d, w in zip(docs, M.brute_force(short)):
        r = got[d.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert (r.base_score, r.score) == pytest.approx(w[3:], rel=1e-9)


def test_long_contexts(spark):
    """The last byte of a word follows from its first, five bytes before: only that is a choice, of one bit."""
    import random

    choice = random.Random(1)
    say = lambda: " ".join(choice.choice(["qbcdex", "rbcdey"]) for _ in range(400))
    df = spark.createDataFrame([(i, say(), i > 0) for i in range(20)], "doc_id long, text string, learn boolean")
    out = {r.doc_id: r for r in M.score(df).collect()}[0]
    assert -out.score / math.log10(2) / 400 < 1.2


def test_heavy_contexts_are_dealt_by_weight(spark, monkeypatch):
    """One three-byte context that stands for a fifth of the text goes to many buckets; the scores are those of brute force."""
    import random

    rng = random.Random(2)
    rows = [(i, " ".join("the" + "".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(20)), i % 3 > 0) for i in range(40)] + [(99, "the" * 90, True), (98, "x", False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").repartition(4)
    want = sorted((r[0], *b) for r, b in zip(rows, M.brute_force([(t, x) for _, t, x in rows])))
    seen = []
    dealt = M._dealt
    monkeypatch.setattr(M, "_dealt", lambda *a: seen.append(dealt(*a)) or seen[-1])
    for most in (500, 60):
        monkeypatch.setattr(M, "MOST_GRAMS", most)
        got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in M.score(df).collect())
        assert [g[:4] for g in got] == [w[:4] for w in want]
        for g, w in zip(got, want):
            assert g[4:] == pytest.approx(w[4:], rel=1e-9, abs=1e-9)
        sizes = {r.bucket: (r.depth, r.n) for r in seen[-1].groupBy("bucket", "depth").agg(F.sum("n").alias("n")).collect()}
        assert all(n <= most for depth, n in sizes.values() if depth < M.DEPTH) and len({d for d, _ in sizes.values()}) > 1
        assert max(d for d, _ in sizes.values()) >= (4 if most == 500 else 5)
