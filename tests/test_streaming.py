import datetime as dt

from lodestack.operators import limits
from lodestack.streaming import limits as S

T = dt.datetime(2024, 1, 1)


def stream(spark, tmp_path, batches, schema):
    src = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
    return spark.readStream.schema(spark.read.parquet(str(src)).schema).option("maxFilesPerTrigger", 1).parquet(str(src))


def finish(df, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    q = df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.read.parquet(out).collect()


def test_login_limiter(spark, tmp_path):
    rows = [(i, "a", T + dt.timedelta(seconds=s), False) for i, s in enumerate([0, 10, 20, 30, 40, 45])] + [(9, "b", T, False)]
    s = stream(spark, tmp_path, [rows[:3] + rows[6:], rows[3:6]], "event_id long, ip string, ts timestamp, ok boolean")
    got = finish(S.login_limiter(s), tmp_path)
    assert sorted(r.failures for r in got) == [5, 6] and {r.ip for r in got} == {"a"}


def test_breaker_like_replay(spark, tmp_path):
    outcomes = ["timeout", "timeout", "ok", "ok", "timeout", "ok"]
    rows = [("s", i, T + dt.timedelta(seconds=15 * i), o) for i, o in enumerate(outcomes)]
    s = stream(spark, tmp_path, [rows[:3], rows[3:]], "name string, event_id long, ts timestamp, outcome string")
    want = {r.event_id: (r.admitted, r.state) for r in limits.breaker_replay(spark.read.parquet(str(tmp_path / "in"))).collect()}
    assert {r.event_id: (r.admitted, r.state) for r in finish(S.breaker(s), tmp_path)} == want


def test_append_sink_is_idempotent(spark, tmp_path):
    write = S.append_sink(str(tmp_path / "sink"))
    df = spark.range(3)
    for n in (0, 1, 1):
        write(df, n)
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 6


def test_once_each(spark, tmp_path):
    s = stream(spark, tmp_path, [[("e", T), ("e", T)], [("e", T), ("f", T)]], "eid string, ts timestamp")
    assert sorted(r.eid for r in finish(S.once_each(s), tmp_path)) == ["e", "f"]
