"""Leases, locks, expiring keys, serial jobs and breakers as stateful streams.

Each is a processor on Spark's arbitrary state: value or map state of a key,
event-time timers, and state that goes by itself. The rows of a key in a batch are
taken in the order of time and id, so a stream whose batches come in order gives
the rows of the batch operator; state is kept between batches and over restarts.
Late rows, beyond the watermark, are dropped by Spark before they come here.

A key's state is a few numbers, or one entry for each lease in force; timers remove
what nobody asks for again. ``prepare`` chooses the state store that these need.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.limits import Breaker

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATE = "1 hour"


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _us(t: pd.Timestamp) -> int:
    return t.value // 1000


class _InOrder(StatefulProcessor):
    """Takes the rows of a key one by one, by ``order``, and gives the rows that ``step`` makes of them."""

    order: list[str] = ["start", "token"]
    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(self.order)
        out = list(self.steps(key, frame))
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = list(self.expired(key, expiredTimerInfo.getExpiryTimeInMs()))
        yield pd.DataFrame(out, columns=self.columns)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def steps(self, key, frame: pd.DataFrame) -> Iterator[tuple]:
        raise NotImplementedError

    def expired(self, key, at_ms: int) -> Iterator[tuple]:
        return iter(())

    def close(self) -> None:
        pass


class Leases(_InOrder):
    """Map state of the leases in force; each has a timer for its end."""

    columns = ["pool", "token", "active"]

    def open(self, handle):
        self.ends = handle.getMapState("ends", "token bigint", "end_us bigint")

    def steps(self, key, frame):
        ends = {k[0]: v[0] for k, v in self.ends.iterator()}
        before = dict(ends)
        for r in frame.itertuples(index=False):
            now = _us(r.start)
            for token in [t for t, end in ends.items() if end <= now]:
                del ends[token]
            end = _us(r.end)
            yield (key[0], r.token, len(ends) + (end > now))  # one of no length is never in force
            if end > now:
                ends[r.token] = end
                self.handle.registerTimer(-(-end // 1000))
        for token in before.keys() - ends.keys():
            self.ends.removeKey((token,))
        for token in ends.keys() - before.keys():
            self.ends.updateValue((token,), (ends[token],))

    def expired(self, key, at_ms):
        for token in [k[0] for k, v in self.ends.iterator() if v[0] <= at_ms * 1000]:
            self.ends.removeKey((token,))
        return iter(())


class Lock(_InOrder):
    """Value state: until when a key is busy; a timer clears it."""

    columns = ["key", "token", "granted"]

    def open(self, handle):
        self.busy = handle.getValueState("busy", "until_us bigint")

    def steps(self, key, frame):
        until = self.busy.get()[0] if self.busy.exists() else None
        for r in frame.itertuples(index=False):
            yield (key[0], r.token, until is None or _us(r.start) >= until)
            until = _us(r.end) if until is None else max(until, _us(r.end))
        self.busy.update((until,))
        self.handle.registerTimer(-(-until // 1000))

    def expired(self, key, at_ms):
        if self.busy.exists() and self.busy.get()[0] <= at_ms * 1000:
            self.busy.clear()
        return iter(())


class Expiring(_InOrder):
    """Value state of a key that lives as long as it is written; a timer, moved with each write, gives what it was when it goes."""

    order = ["ts"]
    columns = ["key", "start", "end", "writes"]

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def open(self, handle):
        self.life = handle.getValueState("life", "first_us bigint, last_us bigint, writes bigint")

    def _row(self, key, first: int, last: int, n: int) -> tuple:
        return (key[0], pd.Timestamp(first * 1000), pd.Timestamp((last + self.gap) * 1000), n)

    def steps(self, key, frame):
        life = self.life.get() if self.life.exists() else None
        for r in frame.itertuples(index=False):
            now = _us(r.ts)
            if life is not None and now - life[1] >= self.gap:
                yield self._row(key, *life)
                life = None
            life = (now, now, 1) if life is None else (life[0], max(life[1], now), life[2] + 1)
        self.life.update(life)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(-(-(life[1] + self.gap) // 1000))

    def expired(self, key, at_ms):
        if self.life.exists() and self.life.get()[1] + self.gap <= at_ms * 1000:
            life = self.life.get()
            self.life.clear()
            yield self._row(key, *life)


class Serial(_InOrder):
    """Value state: how many jobs a key has had, and when the last of them is done."""

    columns = ["key", "token", "place", "done_us"]

    def open(self, handle):
        self.line = handle.getValueState("line", "place bigint, free_us bigint")

    def steps(self, key, frame):
        place, free = self.line.get() if self.line.exists() else (0, None)
        for r in frame.itertuples(index=False):
            start = _us(r.start) if free is None else max(_us(r.start), free)
            place, free = place + 1, start + _us(r.end) - _us(r.start)
            yield (key[0], r.token, place, free)
        self.line.update((place, free))


class Breakers(_InOrder):
    """Value state of a breaker."""

    order = ["ts", "event_id"]
    columns = ["name", "event_id", "admitted", "state"]

    def __init__(self, *settings):
        self.settings = settings

    def open(self, handle):
        self.saved = handle.getValueState("breaker", "state string, failures int, since double, lost int")

    def steps(self, key, frame):
        b = Breaker(*self.settings)
        if self.saved.exists():
            b.load(*self.saved.get())
        for r in frame.itertuples(index=False):
            yield (key[0], r.event_id, b.call(r.ts.timestamp(), r.outcome), b.state)
        self.saved.update(b.save())


class Seen(_InOrder):
    """Value state with a time to live: the first row of a key, once in that time."""

    order = ["ts"]
    columns = ["key", "ts"]

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def open(self, handle):
        self.mark = handle.getValueState("mark", "ts_us bigint", self.ttl)

    def steps(self, key, frame):
        if not self.mark.exists():
            first = frame["ts"].iloc[0]
            self.mark.update((_us(first),))
            yield (key[0], first)


def _by(events: DataFrame, key: str, processor: StatefulProcessor, schema: str, time: str) -> DataFrame:
    return events.groupBy(key).transformWithStateInPandas(processor, schema, "append", time)


def leases(stream: DataFrame, pool: str, late: str = LATE) -> DataFrame:
    """(pool, token, active) of a stream of leases (pool, token, start, end): leases of the pool in force at each start, its own included."""
    kind = dict(stream.dtypes)[pool]
    return _by(stream.withWatermark("start", late), pool, Leases(), f"pool {kind}, token bigint, active bigint", "EventTime")


def locks(stream: DataFrame, key: str, late: str = LATE) -> DataFrame:
    """(key, token, granted): whether the key was free when each lease (key, token, start, end) began."""
    kind = dict(stream.dtypes)[key]
    return _by(stream.withWatermark("start", late), key, Lock(), f"key {kind}, token bigint, granted boolean", "EventTime")


def expiring(stream: DataFrame, key: str, gap_seconds: int, late: str = LATE) -> DataFrame:
    """(key, start, end, writes) of each life of a key that ends when it has not been written for the gap."""
    kind = dict(stream.dtypes)[key]
    return _by(stream.withWatermark("ts", late), key, Expiring(gap_seconds * 1_000_000), f"key {kind}, start timestamp, end timestamp, writes bigint", "EventTime")


def serial(stream: DataFrame, key: str) -> DataFrame:
    """(key, token, place, done_us) of jobs (key, token, start, end) that run one after the other."""
    kind = dict(stream.dtypes)[key]
    return _by(stream, key, Serial(), f"key {kind}, token bigint, place bigint, done_us bigint", "None")


def breakers(stream: DataFrame, threshold: int = 2, cooldown: float = 30.0, give_up: int = 0, rest: float = 60.0) -> DataFrame:
    """(name, event_id, admitted, state) of calls (name, event_id, ts, outcome)."""
    return _by(stream, "name", Breakers(threshold, cooldown, give_up, rest), "name string, event_id bigint, admitted boolean, state string", "None")


def first_in_time(stream: DataFrame, key: str, ttl_seconds: int) -> DataFrame:
    """(key, ts): a key's first row, and none for as long as its mark lives (by the clock)."""
    kind = dict(stream.dtypes)[key]
    return _by(stream, key, Seen(ttl_seconds * 1000), f"key {kind}, ts timestamp", "ProcessingTime")
