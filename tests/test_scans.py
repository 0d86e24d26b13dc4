"""Running values of one key that holds all rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestack.operators import layout, limits, scans
from lodestack.operators.scans import Running

T = dt.datetime(2024, 1, 1)


@pytest.fixture
def small_slices(monkeypatch):
    monkeypatch.setattr(scans, "SLICE_ROWS", 60)


def test_one_key_is_cut(spark, small_slices):
    rng = random.Random(1)
    rows = [("hot", i, rng.choice([None, rng.randrange(-50, 50)])) for i in range(2000)] + [(None, i, i) for i in range(5)] + [("x", 3, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, v long")
    cut = scans.sliced(df, ["k"], ["i"])
    assert cut.groupBy(scans.SLICE).count().agg(F.max("count")).first()[0] < 60 * 3  # no task sees more than a slice
    assert cut.filter("k = 'hot'").select(scans.SLICE).distinct().count() > 15
    v = F.col("v")
    found = scans.running(cut, ["k"], ["i"], {"n": Running("count", v > 0), "s": Running("sum", v, before=True), "m": Running("max", v, before=True), "lo": Running("min", v), "l": Running("last", v)})
    got = {(r.k, r.i): (r.n, r.s, r.m, r.lo, r.l) for r in found.collect()}
    assert len(got) == len(rows)
    for key in ("hot", None, "x"):
        n = s = 0
        m = lo = last = None
        for _, i, x in sorted(r for r in rows if r[0] == key) if key else sorted((r for r in rows if r[0] is None), key=lambda r: r[1]):
            before = (s, m)
            if x is not None:
                n, s, m, lo, last = n + (x > 0), s + x, x if m is None else max(m, x), x if lo is None else min(lo, x), x
            assert got[key, i] == (n, before[0], before[1], lo, last)


def test_failures_in_a_dense_minute(spark, small_slices):
    """One address, many logins in one second and ties."""
    rng = random.Random(2)
    rows = [(i, "a", T + dt.timedelta(seconds=rng.randrange(400) / 4), rng.random() < 0.4) for i in range(1500)] + [(5000, None, T, False)]
    got = {r.event_id: r.failures for r in limits.blocked(spark.createDataFrame(rows, "event_id long, ip string, ts timestamp, ok boolean"), most=1, seconds=10).collect()}
    want = {}
    for i, ip, t, _ in rows:
        n = sum(1 for _, other, u, ok in rows if other == ip and not ok and t - dt.timedelta(seconds=10) <= u <= t)
        if n:
            want[i] = n
    assert got == want


def test_serial_jobs_and_overlaps(spark, small_slices):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        a = T + dt.timedelta(seconds=rng.randrange(9000))
        rows.append((i, "u", a, a + dt.timedelta(seconds=rng.randrange(20))))
    df = spark.createDataFrame(rows, "token long, username string, start timestamp, end timestamp")
    got = {r.token: (r.place, r.done_us) for r in limits.serial(df, "username").collect()}
    clear = {r.token for r in limits.overlapping(df, "username").collect()}
    free, busy = None, None
    for n, (i, _, a, b) in enumerate(sorted(rows, key=lambda r: (r[2], r[0]))):
        start = a if free is None else max(a, free)
        free = start + (b - a)
        assert got[i] == (n + 1, int(free.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000 + 0.5))
        assert (i in clear) == (busy is not None and a < busy)
        busy = b if busy is None else max(busy, b)


def test_headings_of_one_long_document(spark, small_slices):
    rng = random.Random(4)
    rows = [(1, i, f"t{i}", rng.choice([None] * 12 + [1, 2, 3])) for i in range(1200)]
    got = {r.pos: r.path for r in layout.heading_paths(spark.createDataFrame(rows, "doc_id long, pos int, text string, level int"), F.lit("none")).collect()}
    stack = {}
    for _, i, t, level in rows:
        if level:
            stack = {n: x for n, x in stack.items() if n < level} | {level: t}
        else:
            assert got[i] == (" > ".join(stack[n] for n in sorted(stack)) or "none")


def test_empty(spark):
    none = spark.createDataFrame([], "k string, i long")
    assert scans.scan(none, ["k"], ["i"], {"n": Running("count", F.lit(True))}).count() == 0
