import itertools

import numpy as np
from pyspark.sql import functions as F

from lodestack.llm import langid as L


def test_viterbi_like_every_path():
    rng = np.random.default_rng(0)
    first = np.array([0, 0, 5, 6, 10])
    s = rng.normal(size=(10, 3)) * 3
    got = L.viterbi(s, first, penalty=1.5)
    for a, b in zip(first, first[1:]):
        if a == b:
            continue
        value = lambda p: sum(s[a + i, k] for i, k in enumerate(p)) - 1.5 * sum(x != y for x, y in zip(p, p[1:]))
        best = max(itertools.product(range(3), repeat=b - a), key=value)
        assert abs(value(best) - value(tuple(got[a:b]))) < 1e-9


def test_edges_and_mixed_text(spark):
    en, ru = "the house and the garden were here with other people", "дом и сад были здесь вместе с людьми"
    train = spark.createDataFrame([(en, "en"), ("this thing is what they were after then", "en"), (ru, "ru"), ("они были там потом", "ru"), (None, "en"), ("x", None)], "text string, lang string")
    m = L.fit(train)
    assert m.languages == ["en", "ru"]
    rows = [(1, None), (2, ""), (3, "123 ... ¿!"), (4, en), (5, ru), (6, f"{en} {en} {ru} {ru}"), (6, f"{en} {en} {ru} {ru}"), (7, "日本語"), (8, "the " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang_pred": F.lit(1), "lang": F.lit("zz")})
    got = {r.doc_id: r for r in L.identify(df, m).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 8)] == ["und", "und", "und", "en", "ru", "en"]
    assert [s.lang for s in got[6].lang_spans] == ["en", "ru"] and got[6].lang_spans[0].end == 20
    assert got[7].lang_pred in m.languages and all(0 <= r.lang_score <= 1 for r in got.values())
    assert L.identify(df, L.fit(train.limit(0))).first().lang_pred == "und"
    assert L.identify(df.limit(0), m).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = L.query(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert r.n > 100 and r.a > 0.95


def test_query_like_brute_force(spark, tiny):
    import zlib

    docs = spark.read.parquet(f"{tiny}/documents.parquet").collect()
    held = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 4 == 2 for d in docs}
    want = L.brute_force([(d.text, d.lang) for d in docs if not held[d.doc_id]], [d.text for d in docs])
    got = {r.doc_id: r for r in L.query(spark, tiny).collect()}
    assert len(got) == len(docs)
    for d, (pred, score) in zip(docs, want):
        r = got[d.doc_id]
        assert (r.held_out, r.lang_pred) == (held[d.doc_id], pred) and abs(r.score - score) < 1e-12


def test_many_languages(spark):
    """More languages than the model has room for: counters are joined, all languages stay."""
    texts = [(f"wort{chr(97 + i % 26)}{chr(97 + i // 26)} " * 5, f"l{i:03d}") for i in range(300)]
    model = L.fit(spark.createDataFrame(texts, "text string, lang string"))
    assert len(model.languages) == 300 and model.logp.size <= L.MAX_LANGUAGES * L.BUCKETS
    got = L.identify(spark.createDataFrame(texts, "text string, lang string"), model).collect()
    assert sum(r.lang_pred == r.lang for r in got) > 290
