"""Word splitting, contained texts, glossary terms and quote repair against plain versions."""

import hashlib
import itertools
import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestack.functions.text import GLUE_WORDS
from lodestack.operators import containment, segmentation, terms, validation
from measured import shuffled


def all_splits(run, costs, alone):
    """The best of every way to cut a short run."""
    best = None
    for n in range(len(run)):
        for cuts in itertools.combinations(range(1, len(run)), n):
            words = [run[a:b] for a, b in zip((0, *cuts), (*cuts, len(run)))]
            if all(w in costs or len(w) == 1 for w in words):
                key = (sum(costs.get(w, alone) for w in words), len(words), [-len(w) for w in words])
                if best is None or key < best[0]:
                    best = (key, words)
    return best[1]


def test_best_split():
    rng = random.Random(1)
    costs = {w: rng.randrange(1, 9) * 1000 for w in ("a", "ab", "abc", "ba", "bab", "cab", "c", "bca", "aab", "ca")}
    for _ in range(300):
        run = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 11)))
        words = [(i, i + len(w), c) for w, c in costs.items() for i in range(len(run)) if run.startswith(w, i)]
        assert segmentation.best_split(run, words, 14_000) == all_splits(run, costs, 14_000), run


def test_trie_and_join_agree(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    costs = segmentation.word_costs(docs)
    glued = docs.withColumn("text", F.regexp_replace("text", "([a-z]{3,}) ([a-z]{3,}) ([a-z]{3,}) ", "$1$2$3 ")).union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "x" * 30), (-4, "andthe" * 4000)], docs.schema))
    one = {r.doc_id: (r.text, r.split_runs) for r in segmentation.deglued(glued, costs).collect()}
    two = {r.doc_id: (r.text, r.split_runs) for r in segmentation.deglued(glued, costs, shipped_bytes=-1).collect()}
    assert one == two and one[-1] == (None, 0) and one[-2] == ("", 0) and one[-3] == ("x" * 30, 0) and one[-4][1] == 1
    assert one[-4][0].replace(" ", "") == "andthe" * 4000


def test_deglued_query(spark, tiny):
    """Every document: counts, costs, runs and splits said plainly."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    count = Counter(w for t in texts.values() for w in re.findall(r"(?<![A-Za-z])[a-z]+(?![A-Za-z])", t or "") if len(w) <= 20)
    count = {w: n for w, n in count.items() if n >= 2}
    total = sum(count.values())
    costs = {w: math.floor(1000 * math.log(total / n) + 0.5) for w, n in count.items()}
    alone = max(costs.values()) + 5000

    def split(run):
        words = [(i, j, costs[run[i:j]]) for i in range(len(run)) for j in range(i + 1, min(i + 20, len(run)) + 1) if run[i:j] in costs]
        return " ".join(segmentation.best_split(run, words, alone))

    got = {r.doc_id: r for r in entry.queries()["h04_deglued"](spark, tiny).collect()}
    hit = 0
    for i, t in texts.items():
        glued = re.sub("([a-z]{3,}) ([a-z]{3,}) ([a-z]{3,}) ", r"\1\2\3 ", t or "")
        runs = [r for r in re.findall("[a-z]{24,}", glued) if re.search(GLUE_WORDS, r[3:])]
        want = re.sub("[a-z]{24,}", lambda m: split(m[0]) if re.search(GLUE_WORDS, m[0][3:]) else m[0], glued)
        assert got[i].split_runs == len(runs) and got[i].text == hashlib.md5(want.encode()).hexdigest()
        hit += len(runs)
    assert hit > 50


def test_contained(spark):
    rng = random.Random(2)
    lines = {"".join(rng.choice("ab") for _ in range(rng.randrange(6, 40))) for _ in range(150)}
    lines |= {x[rng.randrange(5) : -3] for x in list(lines)[:60]} | {"a" * n for n in range(8, 14)}
    rows = [("g", f"i{n}", x) for n, x in enumerate(sorted(lines))] + [("h", "j", "a" * 9), ("g", "n", "short")]
    df = spark.createDataFrame(rows, "grp string, id string, text string")
    got = {tuple(r) for r in containment.contained(df).collect()}
    want = {(g, i, k) for g, i, x in rows for h, k, y in rows if g == h and len(x) < len(y) and len(x) >= 8 and x in y}
    assert got == want and len(want) > 50


def test_contained_of_all_lengths(spark):
    """Pieces of every class of lengths, in other groups too, and characters beyond 16 bits."""
    rng = random.Random(3)
    longer = ["".join(rng.choice("abcdefgh\U0001d11eé") for _ in range(rng.randrange(300, 1200))) for _ in range(25)] + ["ab" * 300]
    pieces = [x[a : a + n] for x in longer for n in (8, 9, 15, 16, 17, 31, 32, 63, 64, 100, 128, 200, 257) for a in (0, rng.randrange(len(x) - n), len(x) - n)]
    lines = sorted({*longer, *pieces})
    rows = [(g, f"i{n}", x) for g in ("g", "h") for n, x in enumerate(lines) if g == "g" or n % 3] + [(None, "n", longer[0][3:90]), ("g", "null", None)]
    got = [tuple(r) for r in containment.contained(spark.createDataFrame(rows, "grp string, id string, text string")).collect()]
    want = {(g, f"i{i}", f"i{k}") for i, x in enumerate(lines) for k, y in enumerate(lines) if len(x) < len(y) and x in y for g in ("g", "h") if g == "g" or (i % 3 and k % 3)}
    assert set(got) == want and len(got) == len(want) > 1000


def test_contained_writes_few_rows(spark, monkeypatch):
    """what is written does not come to a row for each character."""
    from lodestack.plans.inputs import chunks

    rows, write = [], containment.written

    def counted(df, name):
        out = write(df, name)
        rows.append((name, out.count()))
        return out

    monkeypatch.setattr(containment, "written", counted)
    k = chunks(spark, "/root/testdata/sf0.001").select("source", F.regexp_replace(F.lower("content"), "[^a-z0-9]+", "").alias("k")).filter("length(k) > 8").distinct()
    lines = k.select(F.col("source").alias("grp"), F.md5(F.col("k").cast("binary")).alias("id"), F.col("k").alias("text"))
    containment.contained(lines).count()
    assert sum(n for _, n in rows) < lines.agg(F.sum(F.length("text")).alias("n")).first().n / 20, rows


def test_candidates_follow_the_results(spark):
    """Few candidates for each result on the driver's lines."""
    from lodestack.plans.inputs import chunks

    k = chunks(spark, "/root/testdata/sf0.001").select("source", F.regexp_replace(F.lower("content"), "[^a-z0-9]+", "").alias("k")).filter("length(k) > 8").distinct()
    lines = k.select(F.col("source").alias("grp"), F.md5(F.col("k").cast("binary")).alias("id"), F.col("k").alias("text"))
    n, found, every = containment.candidates(lines).count(), containment.contained(lines).count(), lines.groupBy("grp").count().selectExpr("sum(count * (count - 1) / 2) as n").first().n
    print(f"{n} candidates for {found} pairs of {every}")
    assert found <= n <= max(3 * found, every / 50)


def test_only_compared_lines_are_shuffled(spark):
    """Lines that share a phrase with many others but stand in none stay where they are."""
    rng = random.Random(6)
    line = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    phrases = [line(30) for _ in range(5)]
    texts = [line(300) + rng.choice(phrases) + line(300) for _ in range(1500)] + [line(20) + rng.choice(phrases) + line(20) for _ in range(1500)]
    texts += [t[200:500] for t in texts[:20]]
    lines = spark.createDataFrame([("g", i, t) for i, t in enumerate(texts)], "grp string, id int, text string").repartition(4).cache()
    lines.count()
    small, began = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), shuffled(spark)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        got = sorted(map(tuple, containment.contained(lines).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    moved = shuffled(spark) - began
    assert got == sorted(("g", i, k) for i, x in enumerate(texts[3000:], 3000) for k, y in enumerate(texts) if len(x) < len(y) and x in y) and len(got) == 20
    assert moved < 800_000, moved  # the texts are 1,150,000


def plain_replaced(text, pairs):
    """The longest term first in one alternation, with word bounds for ASCII."""
    own = {k: v for k, v in pairs.items() if k.isascii() == text.isascii()}
    if not own:
        return text
    find = re.compile("|".join(rf"\b{re.escape(k)}\b" if k.isascii() else re.escape(k) for k in sorted(own, key=lambda k: (-len(k), k))), re.I)

    def new(m):
        v = own.get(m[0].lower(), m[0])
        if v == m[0]:
            return v
        before, after = text[: m.start()][-1:], text[m.end() :][:1]
        return (" " if not before.isascii() else "") + v + (" " if not after.isascii() else "")

    return find.sub(new, text)


def test_terms(spark):
    rng = random.Random(3)
    pairs = {"".join(rng.choice("ab c-") for _ in range(rng.randrange(1, 6))).strip(" -") or "a": f"T{n}" for n in range(60)}
    pairs |= {"埋氧层": "box layer", "光刻胶": "resist", "光刻": "no", "氧层ab": "x y z"}
    glossary = spark.createDataFrame(list(pairs.items()) + [("埋氧层", "zz later"), ("waf", "WAF"), (" ", "q"), ("x", "")], "term string, target string")
    usable = terms.usable_terms(glossary)
    kept = {r.term: r.target for r in usable.collect()}
    assert "光刻" not in kept and kept["埋氧层"] == "box layer" and "waf" not in kept and len(kept) > 30
    texts = ["".join(rng.choice(["a", "b", "c", " ", "-", "A", "埋氧层", "光刻胶", "é", "ab"]) for _ in range(rng.randrange(30))) for _ in range(300)] + ["", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    for r in df.select("i", terms.replacer(usable)("text").alias("r")).collect():
        t = texts[r.i]
        assert r.r.text == (None if t is None else plain_replaced(t, kept)), t
    with pytest.raises(ValueError, match="more than"):
        terms.replacer(usable, shipped_bytes=10)
    none = terms.replacer(usable.limit(0))
    assert [r[0] for r in df.limit(3).select(none("text")["text"]).collect()] == texts[:3]


def test_glossary_in_parts(spark):
    """The same texts, whatever part a term is in: longer terms from the same place, terms over others, texts that are longer than a portion."""
    rng = random.Random(4)
    pairs = {"".join(rng.choice("ab -") for _ in range(rng.randrange(1, 7))).strip(" -") or "a": f"T{n}" for n in range(60)}
    pairs |= {"埋氧层": "box layer", "光刻胶": "resist", "埋氧层ab": "longer", "氧层a": "behind"}
    usable = terms.usable_terms(spark.createDataFrame(list(pairs.items()), "term string, target string"))
    kept = {r.term: r.target for r in usable.collect()}
    texts = ["".join(rng.choice(["a", "b", " ", "-", "A", "埋氧层", "光刻胶", "ab"]) for _ in range(rng.randrange(30))) for _ in range(200)] + ["", None, "a " * 90]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").coalesce(2)
    whole = sum(len(t.encode()) + len(g.encode()) + 64 for t, g in kept.items())
    for shipped in (100, whole // 3):
        for r in df.select("i", terms.replacer(usable, shipped, scanned_chars=150)("text").alias("r")).collect():
            t = texts[r.i]
            assert r.r.text == (None if t is None else plain_replaced(t, kept)), t


def test_glossary_query(spark, tiny):
    got = {r.doc_id: r for r in entry.queries()["h09_glossary_terms"](spark, tiny).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    count = Counter(w for t in texts.values() for w in re.findall(r"[^\W\d_]{4,}", (t or "").lower()))
    pairs = {w: f"<{w}>" for w, n in count.items() if n >= 5}
    assert len(pairs) > 1000
    for i in sorted(texts)[:25]:
        want = plain_replaced(texts[i], pairs)
        assert got[i].text == hashlib.md5(want.encode()).hexdigest()


def lexed(s):
    """One character at a time."""
    out, inside, i = [], False, 0
    while i < len(s):
        c, rest = s[i], s[i + 1 :]
        if not inside or c not in '"\\':
            inside |= c == '"'
            out.append(c)
        elif c == "\\":
            known = rest[:1] and rest[0] in '"\\/bfnrtu'
            out.append(c + rest[0] if known else "\\\\")
            i += bool(known)
        else:
            after = rest.lstrip(" \t\r\n")
            inside = not (after and after[0] in ",:}]")
            out.append('\\"' if inside else '"')
        i += 1
    return "".join(out)


def test_quotes():
    rng = random.Random(4)
    for _ in range(5000):
        s = "".join(rng.choice('"\\,:{}[] \na_nu') for _ in range(rng.randrange(25)))
        assert validation.with_quotes_mended(s) == lexed(s), s
    assert json.loads(validation.with_quotes_mended('[{"a": "x "y" z\\_", "b": ""}]')) == [{"a": 'x "y" z\\_', "b": ""}]
    good = json.dumps({"a": ["\"\\", 1, None, {"é": "\n"}]})
    assert validation.with_quotes_mended(good) == good
    assert len(validation.with_quotes_mended('"' + 'a"' * 500_000)) > 1_000_000
