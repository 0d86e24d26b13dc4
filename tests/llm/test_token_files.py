import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import files, token_files

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(token_files.default_vocabulary())


@pytest.fixture(scope="module")
def own():
    with open(token_files.default_vocabulary(), encoding="utf-8") as f:
        return token_files.Encoder(f.read(), None)


def ids(own, text):
    return np.frombuffer(own.encode(text), own.kind).tolist()


CASES = [
    "", " ", "It's 'S !'s 're'll", "x<|endoftext|>y <|STARTOFTEXT|> <|startoftext|>", "é å1́ ́", "ABC123abc,!?a'b''c", "Åẞİ Σσ", "\x00a\x1cb\x7f\x85c d",
    "x" * 5000, "9" * 3000, "-" * 2000, "가가 日本語", "a b　c", "<|endoftext", "http://a.b/c?d=1&e='f'",
]


@pytest.mark.parametrize("text", CASES)
def test_like_the_library(own, library, text):
    assert ids(own, text) == library.encode(text, add_special_tokens=False).ids


def test_random_texts(own, library):
    rng = random.Random(5)
    pool = " \t\n''abcdestSTLVMR.,;:()019éüß漢 　—́‍\x1c\x85İ" + "the ing<|"
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(60)))
        assert ids(own, text) == library.encode(text, add_special_tokens=False).ids, text


def test_bounded_caches(own, library, monkeypatch):
    monkeypatch.setattr(token_files, "CACHE", 3)
    for text in ("a b c d e f", "a1,b2 c3;d4", "a b a b c a d a", "é1é'2é?é"):
        assert ids(own, text) == library.encode(text, add_special_tokens=False).ids


def test_another_kind(library):
    """A tokenizer that the cuts are not made for gets whole texts."""
    import public_tokenizers

    spec = public_tokenizers.path("byte_bpe_50k.json")
    with open(spec, encoding="utf-8") as f:
        own = token_files.Encoder(f.read(), None)
    assert not own.cuts
    assert ids(own, "It is  so") == tokenizers.Tokenizer.from_file(spec).encode("It is  so", add_special_tokens=False).ids


def want(library, rows):
    at, out = 0, []
    for i, text in rows:
        t = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(t), zlib.crc32(np.array(t, "<u4").tobytes())))
        at += len(t)
    return out


def test_query(spark, library, tiny):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").orderBy("doc_id").collect()]
    got = [tuple(r) for r in token_files.query(spark, tiny).orderBy("doc_id").collect()]
    assert got == want(library, rows)


def test_files(spark, library, tmp_path):
    """Many files, nulls, repeated rows, a clashing column; the files hold what the format says."""
    rows = [(7, "b c", 1), (7, "b c", 2), (7, "a", 3), (None, "null id", 4), (3, None, 5), (1, "", 6), (2, "long words " * 300, 7), (9, "<|endoftext|>", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder = token_files.write(df, f"file://{tmp_path}/a", file_bytes=16)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    lines = token_files.manifest(spark, folder).orderBy("part", "seq").collect()
    assert len(lines) > 1 and sum(r.docs for r in lines) == len(rows)
    got = token_files.read(spark, folder).orderBy("place").collect()
    assert [r.place for r in got] == list(range(len(rows)))
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 7, 7, 7, 9]
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 2
        at += r.n_tokens
    flat = np.concatenate([np.fromfile(tmp_path / f"a/{r.name}.bin", "<u2") for r in lines])
    assert flat.tolist() == [i for r in got for i in r.ids]
    for r in lines:
        assert np.fromfile(tmp_path / f"a/{r.name}.idx", "<u8")[-1] == r.tokens
    texts = {tuple(r.ids) for r in got if r.doc_id == 7}
    assert texts == {(*library.encode(t, add_special_tokens=False).ids, 2) for t in ("b c", "a")}


def test_empty_and_wide(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read(spark, token_files.write(empty, f"file://{tmp_path}/e")).count() == 0
    one = spark.createDataFrame([("k", "a b")], "doc_id string, text string")
    folder = token_files.write(one, f"file://{tmp_path}/w", end_id=70_000)
    row = token_files.read(spark, folder, id_type="string").first()
    assert row.doc_id == "k" and row.ids[-1] == 70_000 and token_files.manifest(spark, folder).first().width == 4


def test_a_lost_attempt_is_not_read(spark, tmp_path):
    df = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    folder = token_files.write(df, f"file://{tmp_path}/l")
    (tmp_path / "l/ids-lost.bin").write_bytes(b"\1\0" * 9)
    assert token_files.read(spark, folder).count() == 20
    line = token_files.manifest(spark, folder).first()
    with open(tmp_path / f"l/{line.name}.bin", "ab") as f:
        f.write(b"\1\0")
    with pytest.raises(Exception, match="not as the manifest says"):
        token_files.read(spark, folder).collect()


def test_unknown_scheme(spark):
    with pytest.raises(ValueError, match="cannot be opened by tasks"):
        token_files.write(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "nowhere://x/y")
    assert files.open_folder("/tmp/x")[1] == "/tmp/x" and files.open_folder("file:///tmp/x")[1] == "/tmp/x"
