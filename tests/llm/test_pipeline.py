"""The corpus pipeline against the operators' brute-force versions, stage by stage."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from lodestack.llm import bpe, decontaminate, langid, near_dup, secrets

tokenizers = pytest.importorskip("tokenizers")


def documents(tiny_rows):
    """Documents of the tiny table, with copies, near copies, passages, secrets, nulls and clashing columns."""
    r = random.Random(11)
    rows = [(d.doc_id, d.text, d.lang, d.source) for d in tiny_rows if d.text and len(d.text) < 3000][:120]
    long = [x for x in rows if len(x[1].split()) > 100][:12]
    rows += [(1000 + k, x[1], x[2], x[3]) for k, x in enumerate(long[:4])]
    for k, x in enumerate(long[4:8]):
        w = x[1].split(" ")
        w[r.randrange(len(w))] = "anders"
        rows.append((1100 + k, " ".join(w), x[2], x[3]))
    rows += [(1200, long[8][1] + " password = hunter2hunter2hunter2", long[8][2], "s"), (1201, None, "en", "s"), (1202, "", "en", None), (1203, "12345 ++ 67890", "en", "s"), (None, long[9][1] + " tail", long[9][2], "s")]
    rows += [(1300, long[10][1] + " again", long[10][2], "s")] * 2
    return [(*x, len(x[1]) if x[1] is not None else None, x[0], "y") for x in rows]


def test_pipeline(spark, tiny, tmp_path):
    source = spark.read.parquet(f"{tiny}/documents.parquet").orderBy("doc_id").collect()
    rows = documents(source)
    schema = "doc_id long, text string, lang string, source string, n_chars long, __text_key long, secret_spans string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").limit(20).collect()]
    items.append((9000, " ".join(rows[3][1].split()[:30])))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = P.run(spark, str(tmp_path)).collect()

    train = [(t, lang) for i, t, lang, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    judged = langid.brute_force(train, [x[1] for x in rows])
    kept = [x for x, (pred, score) in zip(rows, judged) if pred != "und" and score >= P.LEAST_SHARE]
    assert 1201 not in {x[0] for x in kept} and len(kept) > 100
    # One of each class: the smallest id; a null id is larger than any.
    big = 10**9
    classes = near_dup.brute_force([(x[0] if x[0] is not None else big, x[1]) for x in kept])
    kept = [x for x in dict.fromkeys(kept) if classes[x[0] if x[0] is not None else big] == (x[0] if x[0] is not None else big)]
    assert not {x[0] for x in kept} & {1000, 1001, 1002, 1003, 1100, 1101}
    dirty = {r[0]: r[5] for r in decontaminate.brute_force([(x[0], x[1]) for x in kept], items)}
    kept = [x for x in kept if not dirty[x[0]]]
    assert rows[3][0] not in {x[0] for x in kept}
    want = []
    tokenizer = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    for i, t, lang, src, *_ in kept:
        out, at = "", 0
        for _, a, b in secrets.brute_force(t):
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        text = out + t[at:]
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        want.append((i, lang, src, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), True))
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(((r.doc_id, r.lang, r.source, r.n_tokens, r.ids_sha256, r.round_trip) for r in got), key=key) == sorted(want, key=key)


def test_columns_stay(spark, tiny):
    """All stages but the last give the columns of documents, clashing names included."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(30).withColumns({"__row": F.lit(1), "__text": F.lit("t"), "__text_key": F.lit(2), "decon_spans": F.lit("d"), "lang_pred": F.lit(3), "node": F.lit("n")})
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, tiny)
        assert docs.columns == [*spark.read.parquet(f"{tiny}/documents.parquet").columns, "__row", "__text", "__text_key", "decon_spans", "lang_pred", "node"]
        assert all((r["__text"], r["decon_spans"], r["lang_pred"], r["node"]) == ("t", "d", 3, "n") for r in docs.collect())
    empty = spark.read.parquet(f"{tiny}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, tiny).count() == 0
