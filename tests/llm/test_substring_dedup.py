import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import substring_dedup as S


def test_spans():
    v = np.random.default_rng(0).permutation(200).astype(np.uint64)
    for n in (1, 2, 6, 45, 50):
        assert S._span_min(v, n).tolist() == [min(v[i : i + n]) for i in range(len(v) - n + 1)]
        h = S._span_hash(np.tile(v[:60], 3), n)
        assert len(h) == 180 - n + 1 and h[0] == h[60] and len(set(h.tolist())) == 60


def corpus():
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(300)}"
    text = lambda n: [word() for _ in range(n)]
    hot, line = text(90), text(20)
    rows = [(1, None), (2, ""), (3, " ".join(text(49))), (4, " ".join(text(50)))]
    rows += [(100 + k, " ".join(text(rng.randrange(60)) + hot + text(rng.randrange(60)))) for k in range(60)]
    rows += [(200 + k, " \n".join(text(40) + line + text(40))) for k in range(40)]
    rows += [(300, "a " * 3000), (301, "a " * 70), (302, "a " * 49), (303, " ".join(hot + hot)), (None, " ".join(hot)), (305, rows[2][1] + " tail"), (306, rows[3][1])]
    rows += [(307, " ".join(hot)), (307, " ".join(hot)), (307, " ".join(text(80)))]
    rng.shuffle(rows)
    return rows


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_words": F.lit("x"), "id": F.lit(1), "tag": F.lit(2), "start": F.lit(3)}).repartition(5)
    return sorted(map(tuple, S.digest(S.deduplicate(df, **more)).collect()), key=str)


@pytest.mark.parametrize("all_hot", [False, True])
def test_like_brute_force(spark, monkeypatch, all_hot):
    if all_hot:  # also where almost every minimiser is hot
        monkeypatch.setattr(S, "hot_minimisers", lambda source, k, w, m, f=S.hot_minimisers: f(source, 10**6, w, m))
    rows = corpus()
    assert run(spark, rows) == sorted(S.brute_force(rows), key=str)


def test_empty(spark):
    assert run(spark, [])  == []
    assert run(spark, [(1, "short"), (2, None)]) == sorted(S.brute_force([(1, "short"), (2, None)]), key=str)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = sorted(S.brute_force(docs))
    assert sorted(map(tuple, S.query(spark, d).collect())) == want and any(r[2] for r in want)
