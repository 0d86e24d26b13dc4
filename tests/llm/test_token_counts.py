import random

import pytest

from lodestack.llm import token_counts as K

tokenizers = pytest.importorskip("tokenizers")


def library(vocabulary, by_byte):
    t = tokenizers.Tokenizer(tokenizers.models.Unigram(vocabulary, unk_id=0, byte_fallback=by_byte))
    t.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(prepend_scheme="always")
    return t


SMALL = [("<unk>", 0.0), ("▁", -1.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("▁a", -3.0), ("ba", -4.0), ("aba", -5.5), ("▁ab", -5.0), ("c", -1.5), ("cc", -3.0), ("é", -3.0)]


def same(c, lib, text):
    ids = lib.encode(text).ids
    assert c.count(text)[0] == len(ids), text


def test_ties_and_unknowns():
    c, lib = K.Counter(SMALL), library(SMALL, False)
    rng = random.Random(1)
    for text in ["", " ", "  ", "abab", "zz", "azzb zz", "▁a ▁", "x"]:
        same(c, lib, text)
    for _ in range(500):
        same(c, lib, "".join(rng.choice("aabbcczé ▁") for _ in range(rng.randrange(25))))


def test_public_vocabulary(spark, tiny):
    vocabulary = K.default_vocabulary()
    lib = library(vocabulary, True)
    docs = spark.read.parquet(f"{tiny}/documents.parquet").collect()
    got = {r.doc_id: r.n_tokens for r in K.query(spark, tiny).collect()}
    assert got == {d.doc_id: len(lib.encode(d.text or "").ids) for d in docs}


def test_edges(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "日本 ☃☃\n\t x", 5), (3, "日本 ☃☃\n\t x", 5), (4, "a" * 20000, 5), (5, "w " * 20000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    lib = library(K.default_vocabulary(), True)
    out = K.count_tokens(df)
    assert out.columns == ["doc_id", "text", "n_tokens", "token_score"]
    assert sorted((r.doc_id, r.n_tokens) for r in out.collect()) == sorted((i, len(lib.encode(t or "").ids)) for i, t, _ in rows)
    assert K.count_tokens(df.limit(0)).count() == 0
