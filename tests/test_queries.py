"""Every query against its oracle at the smallest size; those without one give rows."""

import glob
import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from lodestack import plans

duckdb = pytest.importorskip("duckdb")
D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{D}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NA or v is pd.NaT:
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        return f"{float(v):.6g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted(tuple(one(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, db, name):
    got = entry.queries()[name](spark, D).toPandas()
    if name in plans.ORACLE_SQL:
        want = db.execute(plans.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_tables(spark):
    """d27 counts every event."""
    events = spark.read.parquet(f"{D}/events.parquet").select("user_id", "event_type").toPandas()
    want = events.groupby([events.user_id, events.event_type == "error"]).size()
    got = entry.queries()["d27_log_blocks"](spark, D).collect()
    assert sorted((r.thread_id, r.category, r.n) for r in got) == sorted((f"u{u}", "timeout" if e else "served", n) for (u, e), n in want.items())


@pytest.mark.parametrize("name", ["h14_anchor_share", "h15_bigram_coverage", "u06_lexical_scores"])
def test_all_documents(spark, name):
    """The pairs cover every document."""
    got = entry.queries()[name](spark, f"{D[:-5]}0.01")
    docs = spark.read.parquet(f"{D[:-5]}0.01/documents.parquet")
    assert got.count() == docs.count() > 200 and got.select("doc_id").distinct().count() == docs.count()


def test_gate_sees_whole_answers(spark):
    """Answers that pass keep their whole text."""
    import hashlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    rows = [r for r in entry.queries()["j06_grounding_gate"](spark, D).collect() if r.action == "pass" and len(docs[r.id] or "") > 120]
    assert rows
    for r in rows:
        end = "资料中未找到。" if r.id % 3 == 0 else "结束。"
        assert r.answer == hashlib.md5(f"{docs[r.id]}。共 {r.id * 7 + 11} 台。{end}".encode()).hexdigest()
