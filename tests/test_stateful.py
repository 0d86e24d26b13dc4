"""Stateful streams over the driver's events in small batches, with a restart between, against the batch queries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestack.operators import limits
from lodestack.plans import streams
from lodestack.streaming import stateful

FILES = 2


class Replay:
    """Rows in files by time: the first half comes, the stream ends; the rest comes, and it is started again."""

    def __init__(self, spark, folder, rows, time):
        self.spark, self.folder = spark, folder
        rows = rows.orderBy(time).toPandas()
        self.parts = [rows.iloc[len(rows) * i // FILES : len(rows) * (i + 1) // FILES] for i in range(FILES)]

    def add(self, parts):
        for p in parts:
            p = self.spark.createDataFrame(p, self.schema)
            p.coalesce(1).write.mode("append").parquet(str(self.folder / "in"))

    def run(self, make, schema):
        self.schema, out = schema, str(self.folder / "out")
        half = FILES // 2
        for parts in (self.parts[:half], self.parts[half:]):
            self.add(parts)
            src = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(self.folder / "in"))
            q = make(src).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(self.folder / "ck")).trigger(availableNow=True).start()
            q.awaitTermination(240)
            assert q.exception() is None
        return self.spark.read.parquet(out)


@pytest.fixture
def few(spark):
    stateful.prepare(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_leases(spark, tmp_path, tiny, few):
    rows = streams.leases(spark, tiny).filter("token < 300")
    want = {r.token: r.active for r in limits.lease_load(rows).collect()}
    pooled = rows.withColumn("pool", F.lit("all"))
    got = Replay(spark, tmp_path, pooled, ["start", "token"]).run(lambda s: stateful.leases(s, "pool"), pooled.schema)
    have = {r.token: r.active for r in got.collect()}
    assert {t: (have.get(t), n) for t, n in want.items() if have.get(t) != n} == {} and len(have) == len(want)


def test_locks(spark, tmp_path, tiny, few):
    rows = streams.leases(spark, tiny).filter("token < 300")
    want = {r.token for r in limits.overlapping(rows, "username").collect()}
    got = Replay(spark, tmp_path, rows, ["start", "token"]).run(lambda s: stateful.locks(s, "username"), rows.schema).collect()
    assert {r.token for r in got if not r.granted} == want and len(got) == rows.count()


def test_serial(spark, tmp_path, tiny, few):
    rows = streams.leases(spark, tiny).filter("token < 300")
    want = {r.token: (r.place, r.done_us) for r in limits.serial(rows, "username").collect()}
    got = Replay(spark, tmp_path, rows, ["start", "token"]).run(lambda s: stateful.serial(s, "username"), rows.schema)
    assert {r.token: (r.place, r.done_us) for r in got.collect()} == want


def test_breakers(spark, tmp_path, tiny, few):
    e = spark.read.parquet(f"{tiny}/events.parquet").filter("event_id < 300")
    outcome = F.when(F.col("event_type") == "error", "timeout").when(F.col("event_type") == "signup", "fatal").otherwise("ok")
    rows = e.select(F.concat(F.lit("svc"), (F.col("user_id") % 12).cast("string")).alias("name"), "event_id", F.col("ts").cast("timestamp").alias("ts"), outcome.alias("outcome"))
    want = {r.event_id: (r.admitted, r.state) for r in limits.breaker_replay(rows, cooldown=3600, give_up=2, rest=7200).collect()}
    got = Replay(spark, tmp_path, rows, ["ts", "event_id"]).run(lambda s: stateful.breakers(s, cooldown=3600, give_up=2, rest=7200), rows.schema)
    assert {r.event_id: (r.admitted, r.state) for r in got.collect()} == want


def test_expiring(spark, tmp_path, tiny, few):
    """Every life ends by a timer or by the write that follows it; a last row, much later, lets the watermark pass all of them."""
    rows = spark.read.parquet(f"{tiny}/events.parquet").filter("event_id < 300").select(F.concat(F.lit("u"), (F.col("user_id") % 15).cast("string")).alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")  # timers fire in a batch without rows
    batch = rows.groupBy("key", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    want = sorted((r.key, r.session_window.start, r.session_window.end, r.n) for r in batch.collect())
    end = rows.agg(F.max("ts")).first()[0] + dt.timedelta(days=40)
    after = spark.createDataFrame([("zz", end), ("zz", end + dt.timedelta(days=40))], rows.schema)
    got = Replay(spark, tmp_path, rows.unionByName(after), ["ts"]).run(lambda s: stateful.expiring(s, "key", 6 * 3600), rows.schema)
    assert sorted((r.key, r.start, r.end, r.writes) for r in got.filter("key <> 'zz'").collect()) == want


def test_first_in_time(spark, tmp_path, tiny, few):
    rows = spark.read.parquet(f"{tiny}/events.parquet").filter("event_id < 300").select((F.col("event_id") % 20).alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    want = {r.key: r.ts for r in rows.groupBy("key").agg(F.min("ts").alias("ts")).collect()}
    got = Replay(spark, tmp_path, rows, ["ts"]).run(lambda s: stateful.first_in_time(s, "key", 3600), rows.schema).collect()
    assert {r.key: r.ts for r in got} == want and len(got) == len(want)
