"""Queries on rows that the given tables do not have, against their SQL."""

import random

import duckdb

from lodestack import plans


def same_as_sql(spark, folder, name, **tables):
    """The rows of a query over small tables, which are those of its SQL."""
    db = duckdb.connect()
    for table, rows in tables.items():
        rows.write.parquet(f"{folder}/{table}.parquet")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    got = plans.QUERIES[name](spark, str(folder))
    wanted = db.execute(plans.ORACLE_SQL[name])
    columns = [c[0] for c in wanted.description]
    rows = sorted((tuple(r) for r in got.select(*columns).collect()), key=repr)
    assert rows == sorted(wanted.fetchall(), key=repr)
    return rows


def test_clarify_repeated_and_null_messages(spark, tmp_path):
    # (conv_id + turn) % 11 = 10 leaves the text; other remainders are fixed questions.
    twice = [(c, t, "user", x) for c in (1, 2, 3) for t, x in ((9 - c + 1, "12"), (20 - c + 1, "怎么处理")) for _ in range(2)]
    busy = [(10, t, "user", None) for t in range(11)] + [(21, 0, "user", "\u00e9\u00e9AB\u00e9"), (21, 6, "user", "-"), (21, 11, "user", None), (43, 0, "user", None), (32, 0, "user", "  "), (32, 7, "user", "x")]
    repeats = [(7, t, "user", "-") for t in (2, 3, 3, 3, 10, 10, 11, 12, 13, 14, 14, 14, 15, 16, 21)]
    conversations = spark.createDataFrame([*twice, *busy, *repeats], "conv_id long, turn long, role string, text string")
    same_as_sql(spark, tmp_path, "b16_clarify", conversations=conversations)


def test_extractive_sentences_stay_as_they_are(spark, tmp_path):
    texts = ["0" * 3 + "a" * 36 + "0" + "b" * 9 + "1" + "c" * 39 + "1" + "d" * 30, " lead" + "e" * 35 + "f" * 10 + " g" * 30, None, "", "short 0", "x" * 45 + "\n" + "2y" * 40]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = dict(same_as_sql(spark, tmp_path, "h18_extractive_check", documents=documents))
    assert rows[0].startswith("000a")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_text_points_of_repeated_chunks(spark, tmp_path):
    """rows that come twice, sources that are null; texts are shuffled once, not for each length of word."""
    texts = ["one three two seventeen\nfour five four", " four FIVE\u212aelvin four \n\nab c\nfour five four", "", None, "x" * 40 + " \u00e9abcd\u00e9efghij"]
    rows = [(i % 4, s, "en", texts[i % 5]) for i in range(40) for s in ("a", None)]
    documents = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    found = same_as_sql(spark, tmp_path, "a09_text_points", documents=documents)
    assert len({r[0] for r in found}) < len(found) and any("40" in r[2] for r in found)
    plan = plan_of(plans.QUERIES["a09_text_points"](spark, str(tmp_path)))
    assert plan.count("Aggregate [") == 1 and plan.count("Generate ") == 1


def test_device_tokens_of_odd_runs(spark, tmp_path):
    """every kind of run, looked for once a text."""
    rng = random.Random(4)
    runs = ["".join(rng.choice("aZ9") for _ in range(n)) for n in (1, 2, 3, 4, 5) for _ in range(60)] + ["THE", "The", "the", "Torr", "TORR1", "ABc", "aBC", "12AB", "AB12c"]
    texts = ["".join(rng.choice(runs) + rng.choice([" ", "-", "_", "\u00e9", "\n", "\u00c9"]) for _ in range(rng.randrange(12))) for _ in range(300)]
    documents = spark.createDataFrame(list(enumerate([*texts, ""])), "doc_id long, text string")
    assert len(same_as_sql(spark, tmp_path, "h08_device_tokens", documents=documents)) == 301
    assert plan_of(plans.QUERIES["h08_device_tokens"](spark, str(tmp_path))).count("regexp_extract_all") == 1


def test_gold_ranks_list_every_gold_pair(spark, tiny):
    v = spark.read.parquet(f"{tiny}/embeddings.parquet").select("vec_id", "label").collect()
    gold = {(q.vec_id, g.vec_id) for q in v if q.vec_id % 50 == 0 for g in v if g.label == q.label and g.vec_id != q.vec_id}
    rows = plans.QUERIES["d29_gold_ranks"](spark, tiny).collect()
    assert len(rows) == len(gold) and {(r.query_id, r.chunk_id) for r in rows} == gold


def test_arrow_batches_are_cut_by_bytes(spark, tiny):
    import __spark_entry__ as driver

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for given, kept in (("64m", str(driver.BATCH_BYTES)), ("67108864b", str(driver.BATCH_BYTES)), ("1000", "1000")):
            spark.conf.set(name, given)
            driver.queries()["h05_sentence_ends"](spark, tiny)
            assert spark.conf.get(name).removesuffix("b") == kept
    finally:
        spark.conf.set(name, before)
