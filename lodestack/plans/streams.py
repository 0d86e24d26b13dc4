"""Rate limits and stateful operators, over event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import limits
from .inputs import REQUESTS, requests, table
from .registry import query


def logins(spark, d):
    return table(spark, d, "events").select("event_id", F.concat(F.lit("ip"), (F.col("user_id") % 3).cast("string")).alias("ip"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"))


@query(
    "k01_login_limit",
    "WITH l AS (SELECT event_id, 'ip' || (user_id % 3) AS ip, ts, event_type <> 'error' AS ok FROM events), f AS (SELECT event_id, ip, count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY ip ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS failures FROM l) SELECT * FROM f WHERE failures >= 3",
)
def login_limit(spark, d):
    return limits.blocked(logins(spark, d), most=3, seconds=3600).select("event_id", "ip", "failures")


LEASES = "l AS (SELECT event_id AS token, 'u' || (user_id % 40) AS username, ts AS start, ts + to_microseconds(CAST(floor(value * 20) AS BIGINT) * 1000000) AS stop FROM events)"


def leases(spark, d):
    e = table(spark, d, "events")
    end = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * 20).cast("bigint") * 1_000_000)
    return e.select(F.col("event_id").alias("token"), F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("username"), F.col("ts").cast("timestamp").alias("start"), end.alias("end"))


@query("k02_lease_load", f"WITH {LEASES}, e AS (SELECT token, start AS place, 1 AS step FROM l UNION ALL SELECT token, stop, -1 FROM l), c AS (SELECT *, sum(step) OVER (ORDER BY place, step, token) AS active FROM e) SELECT token, CAST(active AS BIGINT) AS active FROM c WHERE step = 1")
def lease_load(spark, d):
    return limits.lease_load(leases(spark, d)).select("token", "active")


@query("k03_overlapping_sessions", f"WITH {LEASES}, b AS (SELECT *, max(stop) OVER (PARTITION BY username ORDER BY start, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM l) SELECT token, username FROM b WHERE start < busy")
def overlapping(spark, d):
    return limits.overlapping(leases(spark, d), "username").select("token", "username")


@query("k04_circuit_breaker")
def breaker(spark, d):
    e = table(spark, d, "events")
    outcome = F.when(F.col("event_type") == "error", "timeout").when(F.col("event_type") == "signup", "fatal").otherwise("ok")
    return limits.breaker_replay(e.select((F.concat(F.lit("svc"), (F.col("user_id") % 12).cast("string"))).alias("name"), "event_id", F.col("ts").cast("timestamp").alias("ts"), outcome.alias("outcome")), cooldown=3600, give_up=2, rest=7200)


@query("k07_expired_keys", f"WITH {REQUESTS}, g AS (SELECT username, ts, lag(ts) OVER (PARTITION BY username ORDER BY ts) AS before FROM requests), s AS (SELECT username, ts, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 6 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY username ORDER BY ts) AS n FROM g) SELECT username, count(DISTINCT n) AS sessions, count(*) AS writes FROM s GROUP BY username")
def expired(spark, d):
    s = requests(spark, d).groupBy("username", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return s.groupBy("username").agg(F.count("*").alias("sessions"), F.sum("n").alias("writes"))


@query("k08_after_cursor", f"WITH {REQUESTS}, c AS (SELECT username, max(event_id) AS cursor FROM requests WHERE event_id % 4 = 0 GROUP BY username) SELECT username, count(*) FILTER (WHERE event_id <= cursor) AS summarised, count(*) FILTER (WHERE cursor IS NULL OR event_id > cursor) AS recent FROM requests LEFT JOIN c USING (username) GROUP BY username")
def after_cursor(spark, d):
    r = requests(spark, d)
    c = r.filter("event_id % 4 = 0").groupBy("username").agg(F.max("event_id").alias("cursor"))
    joined = r.join(c, "username", "left")
    old = F.coalesce(F.col("event_id") <= F.col("cursor"), F.lit(False))
    return joined.groupBy("username").agg(F.count_if(old).alias("summarised"), F.count_if(~old).alias("recent"))


@query("k09_serial_jobs", f"WITH {LEASES}, n AS (SELECT token, username, start, epoch_us(stop) - epoch_us(start) AS took, row_number() OVER (PARTITION BY username ORDER BY start, token) AS place FROM l), s AS (SELECT *, sum(took) OVER (PARTITION BY username ORDER BY place) AS total FROM n) SELECT token, username, place, CAST(max(epoch_us(start) - (total - took)) OVER (PARTITION BY username ORDER BY place) + total AS BIGINT) AS done_us FROM s")
def serial_jobs(spark, d):
    return limits.serial(leases(spark, d), "username").select("token", "username", F.col("place").cast("int").alias("place"), "done_us")
