import re
from collections import Counter

from pyspark.sql import functions as F

from lodestack.llm import quality as Q


def counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c, cov = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7)), set()
    for k in range(len(w) - 7):
        if c[tuple(w[k : k + 8])] > 1:
            cov |= set(range(k, k + 8))
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cov))


LINE = "eins zwei drei vier fünf sechs sieben acht neun"
TEXTS = [None, "", " \n\t", "é日本 a#b", f"{LINE}\n{LINE}\n\n{LINE} ", "a " * 40, "x\r\nx\n x\nx", f"{LINE} {LINE}", "w " * 40000, "|".join("ab") * 30]


def test_counts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").withColumn("n_words", F.lit("x"))
    for r in Q.measure(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(TEXTS[r.doc_id]), r.doc_id
    assert Q.measure(df.limit(0)).count() == 0


def test_buckets(spark):
    values = [*range(300), 1000, 65535, 65536, 10**6, 10**12]
    df = spark.createDataFrame([(v,) for v in values], "v long").withColumn("b", Q.bucket_of("v")).withColumn("top", Q.top_of("b"))
    last = -1
    for r in df.orderBy("v").collect():
        assert r.b >= last and r.v <= r.top <= r.v * 33 / 32 + 1
        last = r.b


def test_judge(spark):
    words = [f"wort{i}" for i in range(60)]
    rows = [(i, " ".join(words[i % 30 :]), "de" if i % 2 else None, "s") for i in range(600)]
    rows += [(1000, " ".join(w + "###" for w in words), "de", "s"), (1000, " ".join(w + "###" for w in words), "de", "s"), (1001, None, "de", None), (1002, "a " * 50, "xx", "rare")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n", F.lit(1))
    got = Q.judge(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].kept for i in range(600))
    assert not by[1000].kept and "symbols" in by[1000].failed and not by[1000].base_failed
    assert by[1001].base_failed and by[1002].base_failed and not by[1002].kept
    assert Q.judge(df.limit(0)).count() == 0


def test_learned_fences(spark):
    """Each measure rejects a document that passes the base rule, where the others are clean."""
    words = [f"wort{i}" for i in range(100)]
    clean = "\n".join(" ".join(words[k : k + 10]) for k in range(0, 100, 10))
    run, odd = [f"lauf{i}" for i in range(8)], {}
    odd["repeats"] = " ".join(words[:42] + run + words[42:84] + run)  # 16 of 100 words
    odd["symbols"] = clean + " ##"
    odd["dup_lines"] = clean + "\nx" * 6
    odd["word_length"] = clean.replace("wort", "langeswort")
    rows = [(i, clean, "de", "s") for i in range(600)] + [(1000 + i, t, "de", "s") for i, t in enumerate(odd.values())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    by = {r.doc_id: r for r in Q.judge(df).collect()}
    assert all(by[i].kept for i in range(600))
    for i, m in enumerate(odd):
        assert not by[1000 + i].base_failed and m in by[1000 + i].failed and not by[1000 + i].kept, m


def test_small_groups_borrow(spark):
    """A source's fence goes from its language's to its own as it grows, without a jump."""
    highs = []
    for n in (1, 50, 199, 200, 201, 20000):
        rows = [("de", "big", {"symbols": 0})] * 20000 + [("de", "own", {"symbols": 400_000})] * n
        df = spark.createDataFrame(rows, "lang string, source string, values map<string, bigint>")
        highs.append(Q.fences(df).filter("source = 'own'").first().high)
    assert highs == sorted(highs) and highs[0] < 30_000 and highs[-1] > 390_000
    assert highs[4] - highs[2] < 5_000


def test_thresholds_of_every_group(spark):
    """Fences against plain Python: quartiles of sketches, drawn towards the wider groups."""
    import random

    r = random.Random(7)
    data = [(r.choice(["de", "en", None]), r.choice(["a", "b", None]), {m: r.choice([0, 5, 63, 64, 900, r.randrange(10**6)]) for m in Q.MEASURES}) for _ in range(700)]
    got = {(x.lang, x.source, x.measure): (x.low, x.high) for x in Q.fences(spark.createDataFrame(data, "lang string, source string, values map<string, bigint>")).collect()}

    def top(v):
        if v < 64:
            return v
        shift = v.bit_length() - 6
        return ((v >> shift) + 1 << shift) - 1

    def quartile(values, q):
        values = sorted(top(v) for v in values)
        return next(v for i, v in enumerate(values, 1) if i * 4 >= len(values) * q)

    for (lang, source, m), (low, high) in got.items():
        groups = [[x[2][m] for x in data if test(x)] for test in (lambda x: True, lambda x: x[0] == lang, lambda x: x[:2] == (lang, source))]  # noqa: B023
        q = {}
        for k in (1, 3):
            q[k] = quartile(groups[0], k)
            for own in groups[1:]:
                q[k] = (len(own) * quartile(own, k) + Q.PRIOR * q[k]) // (len(own) + Q.PRIOR)
        reach = Q.REACH * max(q[3] - q[1], Q.FLOORS[m])
        assert high == q[3] + reach and low == (q[1] - reach if Q.MEASURES[m][1] else -1)
    assert len(got) == 9 * len(Q.MEASURES)
