import pytest

from lodestack.llm import decontaminate as D

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
DOCS = [
    (1, f"x {LONG} y"), (2, None), (3, ""), (4, "Tiny Item here"), (4, "Tiny Item here"), (5, "... !!"), (6, f"{LONG} {LONG}"),
    (7, "alpha beta"), (8, "mu lambda kappa iota theta eta zeta epsilon delta gamma beta alpha"), (9, "w " * 30000 + LONG), (10, "tiny\nitem, HERE"), (11, "a a a a a a a a a a a a a"),
]
ITEMS = [(10, LONG), (11, LONG.upper()), (12, "tiny item"), (13, None), (14, "--"), (15, "a a a a a a a a a a a")]


def frames(spark, docs=DOCS, items=ITEMS):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 100])
def test_edges(spark, block):
    docs, items = frames(spark)
    got = sorted(map(tuple, D.digest(D.find_contamination(docs, items, block_bytes=block)).collect()))
    assert got == sorted(D.brute_force(DOCS, ITEMS))


def test_empty_tables_and_clashing_names(spark):
    docs, items = frames(spark, [], [])
    assert D.find_contamination(docs, items).count() == 0
    docs, items = frames(spark, DOCS, [])
    docs = docs.selectExpr("*", "1 AS decon_words", "2 AS start")
    out = D.find_contamination(docs, items)
    assert out.columns == ["doc_id", "text", "start", "decon_words", "decon_spans", "decon_items", "decon_near"]
    assert all(r.decon_spans == [] for r in out.collect())


def test_proximity(spark):
    docs, items = frames(spark)
    near = {r.doc_id: set(r.decon_near) for r in D.find_contamination(docs, items, slop=12).collect()}
    assert "10" in near[8] and "10" not in near[7] and "12" in near[4]


def test_query(spark, tiny):
    rows = lambda t, i: [(r[i], r.text) for r in spark.read.parquet(f"{tiny}/{t}.parquet").collect()]
    got = sorted(map(tuple, D.query(spark, tiny).collect()))
    assert got == sorted(D.brute_force(rows("documents", "doc_id"), rows("benchmark", "item_id")))
    assert any(r[5] for r in got)


def test_proximity_like_brute_force(spark):
    """Words put in, left out, turned around, and repeated; in shards of many documents."""
    import random

    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([1, 3, 9, 10, 14])))) for i in range(30)]
    docs = []
    for i in range(200):
        w = r.choice(items)[1].split()
        for _ in range(r.randrange(4)):
            k = r.randrange(len(w) + 1)
            w[k:k] = [r.choice(vocabulary)]
        if r.random() < 0.3:
            r.shuffle(w)
        if r.random() < 0.3:
            del w[r.randrange(len(w))]
        docs.append((i, " ".join(r.choices(vocabulary, k=r.randrange(30)) + w + r.choices(vocabulary, k=r.randrange(30)))))
    got = sorted(map(tuple, D.digest(D.find_contamination(*frames(spark, docs, items))).collect()))
    want = sorted(D.brute_force(docs, items))
    assert got == want and sum(x[6] for x in want) > sum(x[3] for x in want) > 100


def test_benchmark_of_many_blocks(spark):
    """The benchmark is read block by block; its size and its copies change nothing."""
    docs, _ = frames(spark)
    items = ITEMS + [(100 + i, f"filler{i} {LONG[: 20 + i % 40]} end{i}") for i in range(1200)]
    one = sorted(map(tuple, D.digest(D.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"))).collect()))
    many = D.prepare(spark.createDataFrame(items, "item_id long, text string"), block_bytes=2000)
    assert many.count() > 20
    assert one == sorted(map(tuple, D.digest(D.search(D.build_index(docs), many)).collect())) == sorted(D.brute_force(DOCS, items))
