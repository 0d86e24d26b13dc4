"""Streaming forms of rate limits, expiry and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.limits import Breaker


def login_limiter(logins: DataFrame, most: int = 5, seconds: int = 60) -> DataFrame:
    """(ip, ts, failures) of logins that have ``most`` failures in the seconds up to them.

    ``logins``: a stream of ip, ts, ok, event_id. The state of an address is the
    times of its failures in the window, and goes once they have all passed.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for r in rows.itertuples(index=False):
            now = r.ts.value // 1000
            times = [t for t in times if t >= now - seconds * 1_000_000]
            if not r.ok:
                times.append(now)
            if len(times) >= most:
                out.append((key[0], r.ts, len(times)))
        if times:
            state.update((times,))
            state.setTimeoutDuration(seconds * 1000)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["ip", "ts", "failures"])

    return logins.groupBy("ip").applyInPandasWithState(step, "ip string, ts timestamp, failures int", "times array<bigint>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def breaker(calls: DataFrame, threshold: int = 2, cooldown: float = 30.0, give_up: int = 0, rest: float = 60.0) -> DataFrame:
    """(name, event_id, admitted, state) of a stream of calls (name, event_id, ts, outcome), with the breaker's state kept between batches."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        b = Breaker(threshold, cooldown, give_up, rest)
        if state.exists:
            b.load(*state.get)
        out = []
        for r in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples(index=False):
            out.append((key[0], r.event_id, b.call(r.ts.timestamp(), r.outcome), b.state))
        state.update(b.save())
        yield pd.DataFrame(out, columns=["name", "event_id", "admitted", "state"])

    return calls.groupBy("name").applyInPandasWithState(step, "name string, event_id bigint, admitted boolean, state string", "state string, failures int, since double, lost int", "append", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key that end after a gap, as keys expire that are not written again."""
    return events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once_each(events: DataFrame, key: str = "eid", late: str = "2 minutes") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def append_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes every batch once: a batch that comes again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
