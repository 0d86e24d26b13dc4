"""Table functions called by SQL, and calls that their specs refuse."""

import pytest

from lodestack.functions import table_functions as tf


@pytest.fixture(scope="module")
def hits(spark):
    tf.register(spark)
    rows = [(q, c, 10.0 - c, f"fam{c % 2}_p1", "portrait" if c == 0 else None, f"text {c}", "kept") for q in range(3) for c in range(6)]
    spark.createDataFrame(rows, "query_id int, chunk_id string, score double, source_stem string, content_type string, content string, place string").createOrReplaceTempView("tf_hits")
    return spark


def call(spark, text):
    return [r.asDict() for r in spark.sql(text).collect()]


def test_search_text(hits):
    got = call(hits, "SELECT * FROM search_text(TABLE(tf_hits) PARTITION BY query_id ORDER BY (score DESC, chunk_id), k => 3, score_ratio => 0.85) ORDER BY query_id, place")
    assert [(r["query_id"], r["chunk_id"], r["place"]) for r in got] == [(q, str(c), c + 1) for q in range(3) for c in range(2)]  # a column named as an added one gives way
    got = call(hits, "SELECT * FROM search_text(TABLE(tf_hits) PARTITION BY query_id ORDER BY score DESC, scope_stem => 'fam1', score_ratio => 0.0) WHERE query_id = 2 ORDER BY place")
    assert [r["chunk_id"] for r in got] == ["1", "3", "5"]


def test_search_image_and_get_chunk(hits):
    got = call(hits, "SELECT * FROM search_image(TABLE(tf_hits) PARTITION BY query_id ORDER BY score DESC, k => 1) ORDER BY query_id")
    assert [r["chunk_id"] for r in got] == ["1"] * 3
    got = call(hits, "SELECT * FROM search_image(TABLE(tf_hits) PARTITION BY query_id ORDER BY score DESC, k => 1, include_portraits => true) ORDER BY query_id")
    assert [r["chunk_id"] for r in got] == ["0"] * 3
    got = call(hits, "SELECT * FROM get_chunk(TABLE(tf_hits) PARTITION BY query_id, chunk_id => '4', max_chars => 3)")
    assert [(r["content"], r["shown"]) for r in got] == [("text 4", "tex")] * 3
    assert call(hits, "SELECT * FROM get_chunk(TABLE(tf_hits) PARTITION BY query_id, chunk_id => 'nothing')") == []


@pytest.mark.parametrize(
    "arguments, said",
    [("k => 99", "k is out of range"), ("k => 'three'", "k must be int"), ("k => true", "k must be int"), ("size => 3", "unknown argument size"), ("scope_stem => repeat('x', 300)", "scope_stem is too long"), ("k => cast(rand() as int)", "k must be a constant"), ("score_ratio => -0.5", "score_ratio is out of range")],
)
def test_refused(hits, arguments, said):
    with pytest.raises(Exception, match=said):
        hits.sql(f"SELECT * FROM search_text(TABLE(tf_hits) PARTITION BY query_id, {arguments})").collect()


def test_refused_tables(hits):
    hits.range(3).createOrReplaceTempView("tf_ids")
    with pytest.raises(Exception, match="no column score"):
        hits.sql("SELECT * FROM search_text(TABLE(tf_ids) PARTITION BY id)").collect()
    with pytest.raises(Exception, match="chunk_id is missing"):
        hits.sql("SELECT * FROM get_chunk(TABLE(tf_hits) PARTITION BY query_id)").collect()
    with pytest.raises(Exception, match="takes one table"):
        hits.sql("SELECT * FROM search_text(k => 3)").collect()


def test_checked():
    rules = tf.FUNCTIONS["search_text"].parameters
    assert tf.checked("search_text", rules, {"k": 5}) == {"k": 5, "score_ratio": 0.6, "scope_stem": ""}
