"""Rate limits, leases and breakers replayed over event tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scans import SLICE, Running, counted_within, running, scan, sliced

def blocked(logins: DataFrame, most: int = 5, seconds: int = 60) -> DataFrame:
    """Logins with ``most`` failures of their address or more in the seconds up to them, their own included."""
    placed = logins.withColumn("__us", F.unix_micros("ts"))
    return counted_within(placed, ["ip"], "__us", seconds * 1_000_000, ~F.col("ok"), "failures").drop("__us").filter(F.col("failures") >= most)


def lease_load(leases: DataFrame) -> DataFrame:
    """(token, start, active): leases in force at each start, its own included.

    A lease that ends at the moment another starts is over. The running count
    needs one order over all events: they are counted by hours first, so a task
    sorts the events of one hour only.
    """
    events = leases.select("token", F.col("start").alias("at"), F.lit(1).alias("step")).unionByName(leases.select("token", F.col("end").alias("at"), F.lit(-1).alias("step")))
    hourly = events.withColumn("hour", F.date_trunc("hour", "at"))
    # One row an hour.
    base = hourly.groupBy("hour").agg(F.sum("step").alias("net")).withColumn("before", F.coalesce(F.sum("net").over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("hour").orderBy("at", "step", "token").rowsBetween(Window.unboundedPreceding, 0)
    counted = hourly.withColumn("inside", F.sum("step").over(w)).join(base.select("hour", "before"), "hour")
    return counted.filter("step = 1").select("token", F.col("at").alias("start"), (F.col("before") + F.col("inside")).alias("active"))


def overlapping(leases: DataFrame, key: str) -> DataFrame:
    """Leases of a key that start before an earlier one of it has ended."""
    found = scan(leases, [key], ["start", "token"], {"busy_until": Running("max", F.col("end"), before=True)})
    return found.filter(F.col("start") < F.col("busy_until"))


def serial(jobs: DataFrame, key: str) -> DataFrame:
    """Jobs of a key one after the other: ``place`` and ``done_us``, when each ends.

    A job starts when it has come (``start``) and the one before it is done, and
    takes until ``end`` from its start. With T the work up to a job, it ends at T
    plus the largest (arrival - work before) so far.
    """
    order = ["start", "token"]
    took = jobs.withColumn("__took", F.unix_micros("end") - F.unix_micros("start"))
    cut = sliced(took, [key], order)
    summed = running(cut, [key], order, {"place": Running("count", F.lit(True)), "__total": Running("sum", F.col("__took"))})
    free = F.unix_micros("start") - (F.col("__total") - F.col("__took"))
    found = running(summed.withColumn("__free", free), [key], order, {"__late": Running("max", F.col("__free"))})
    return found.withColumn("done_us", F.col("__late") + F.col("__total")).drop("__took", "__total", "__free", "__late", SLICE)


class Breaker:
    """Closed or open; after the cooldown one call is let through as a probe, which closes or opens it anew.

    ``threshold`` failures in a row open a closed one; a fatal outcome says
    nothing about the service there, but is a failed probe. With ``give_up``, so
    many failed probes in a row make it refuse all calls for ``rest`` seconds;
    after them the probes are counted anew.
    """

    def __init__(self, threshold: int = 2, cooldown: float = 30.0, give_up: int = 0, rest: float = 60.0):
        self.threshold, self.cooldown, self.give_up, self.rest = threshold, cooldown, give_up, rest
        self.load("closed", 0, 0.0, 0)

    def load(self, state: str, failures: int, since: float, lost: int) -> Breaker:
        self.state, self.failures, self.since, self.lost = state, failures, since, lost
        return self

    def save(self) -> tuple:
        return self.state, self.failures, self.since, self.lost

    def call(self, now: float, outcome: str) -> bool:
        """Whether the call is let through; its outcome is counted if it is."""
        waited = now - self.since
        if self.state == "given_up" and waited >= self.rest:
            self.state, self.lost = "open", 0
        if self.state == "given_up" or (self.state == "open" and waited < self.cooldown):
            return False
        if outcome == "ok":
            self.load("closed", 0, now, 0)
        elif self.state == "open":  # the probe has failed
            given_up = 0 < self.give_up <= self.lost + 1
            self.load("given_up" if given_up else "open", self.failures, now, self.lost + 1)
        elif outcome != "fatal":
            self.load("closed" if self.failures + 1 < self.threshold else "open", self.failures + 1, now, 0)
        return True


def breaker_replay(calls: DataFrame, threshold: int = 2, cooldown: float = 30.0, give_up: int = 0, rest: float = 60.0) -> DataFrame:
    """(name, event_id, admitted, state) of each call in the order of time, by name.

    The calls of a name stream through one task in order, which holds the state
    of its breaker and nothing else.
    """

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, b = None, Breaker()
        for pdf in batches:
            admitted, state = [], []
            for own, ts, outcome in zip(pdf["name"], pdf["ts"], pdf["outcome"], strict=True):
                if own != name or name is None:
                    name, b = own, Breaker(threshold, cooldown, give_up, rest)
                admitted.append(b.call(ts.timestamp(), outcome))
                state.append(b.state)
            yield pdf[["name", "event_id"]].assign(admitted=admitted, state=state)

    ordered = calls.select("name", "event_id", "ts", "outcome").repartition("name").sortWithinPartitions("name", "ts", "event_id")
    return ordered.mapInPandas(replay, "name string, event_id bigint, admitted boolean, state string")
