"""Runs followed as they happen, with state and timers for each: tails with a cursor, leases, throttled progress, breakers.

Each is the streaming form of a batch operator (``feeds.until_terminal``, ``feeds.leases``, ``feeds.throttled``, ``ledger.breaker_states``)
and decides alike; what those can only see at the end of their input, a lease that ran out, a held progress event, a breaker that
closes again, a timer brings up here.  Timers of a tail go by the clock; the others by the watermark, so a replay of the same events
fires them alike.  One key's events of one micro-batch are sorted in memory: bound micro-batches at the source.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.feeds import LEASE_SECONDS, LEASES, TERMINAL_EVENTS

PAGE, HEARTBEAT_MS, LIFETIME_MS = 100, 15_000, 600_000


def _stores(spark: SparkSession) -> None:
    """State with timers needs a store that can scan by time."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _kind(frame: DataFrame, name: str) -> str:
    return frame.schema[name].dataType.simpleString()


class _Keyed(StatefulProcessor):
    """One value and at most one timer a key."""

    schema, empty = "", ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", f"{self.schema}, timer long")

    def load(self) -> list:
        found = self.value.get() if self.value.exists() else None
        return list(found) if found is not None else [*self.empty, None]

    def store(self, values: list, timer: int | None) -> None:
        """Keep ``values`` and have one timer at ``timer``."""
        before = values[-1]
        if before != timer:
            if before is not None:
                self.handle.deleteTimer(before)
            if timer is not None:
                self.handle.registerTimer(timer)
        self.value.update((*values[:-1], timer))

    def close(self) -> None:
        pass


class Tail(_Keyed):
    """Events of a run in order and once each, up to its end; a heartbeat when nothing comes, an end of its own after a lifetime."""

    schema, empty = "cursor long, ended boolean, began long", (None, False, None)

    def __init__(self, after: int, heartbeat: int | None, lifetime: int):
        self.after, self.heartbeat, self.lifetime = after, heartbeat, lifetime

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        values = self.load()
        now = timerValues.getCurrentProcessingTimeInMs() if self.heartbeat else 0
        cursor = self.after if values[0] is None else values[0]
        ended = values[1]
        for seq, kind in sorted((r["seq"], r["event_type"]) for r in rows):
            if seq <= cursor or ended:
                continue
            cursor, ended = seq, kind in TERMINAL_EVENTS
            yield Row(run_id=key[0], seq=seq, event_type=kind)
        self.store([cursor, ended, values[2] or now, values[3]], now + self.heartbeat if self.heartbeat and not ended else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        values = self.load()
        now = timerValues.getCurrentProcessingTimeInMs()
        over = now - values[2] >= self.lifetime
        values[-1] = None  # it has fired
        self.store([values[0], values[1] or over, values[2], None], None if over or values[1] else now + self.heartbeat)
        yield Row(run_id=key[0], seq=None, event_type="LIFETIME_OVER" if over else "HEARTBEAT")


def tails(events: DataFrame, after: int = -1, heartbeat: int | None = None, lifetime: int = LIFETIME_MS) -> DataFrame:
    """``events(run_id, seq, event_type)`` -> the same, by run in order, from after a place to its first end.

    With ``heartbeat`` milliseconds of silence a row without ``seq`` tells of it, and one of the end of a lifetime; timers by the clock
    keep a query from ending by itself, so leave them out where only what is there is to be read.  An event that was told, or that comes with a lower ``seq`` than
    one that was, is not told again."""
    _stores(events.sparkSession)
    out = f"run_id {_kind(events, 'run_id')}, seq long, event_type string"
    return events.select("run_id", F.col("seq").cast("long").alias("seq"), "event_type").groupBy("run_id").transformWithState(Tail(after, heartbeat, lifetime), out, "Append", "ProcessingTime" if heartbeat else "None")


def tail(events: DataFrame, run_id: str, after: int, checkpoint: str, told: Callable[[list], None], page: int = PAGE, heartbeat: int | None = HEARTBEAT_MS, lifetime: int = LIFETIME_MS, **trigger) -> StreamingQuery:
    """Follow one run: all its events after a place go to ``told``, a page at a time and in order; the run's end stops the query.

    A micro-batch of any size is read page by page, and ``told`` holds it up for as long as it takes.  The cursor is state, so a
    query that is started again from ``checkpoint`` goes on where it was.  The input is polled every 300 milliseconds; with the trigger
    ``availableNow=True`` what is there is told, without heartbeats, and the query ends."""
    trigger = trigger or {"processingTime": "300 milliseconds"}
    query: list[StreamingQuery] = []
    started = threading.Event()

    def stop() -> None:
        started.wait()
        query[0].stop()

    def show(batch: DataFrame, _: int) -> None:
        held: list = []
        over = False
        for r in batch.orderBy(F.col("seq").asc_nulls_last()).toLocalIterator(prefetchPartitions=True):
            held.append((r["seq"], r["event_type"]))
            over = over or r["event_type"] in (*TERMINAL_EVENTS, "LIFETIME_OVER")
            if len(held) == page:
                told(held)
                held = []
        if held:
            told(held)
        if over:  # not from here: the query waits for this function
            threading.Thread(target=stop, daemon=True).start()

    rows = tails(events.where(F.col("run_id") == F.lit(run_id)), after, None if "availableNow" in trigger else heartbeat, lifetime)
    query.append(rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(show).trigger(**trigger).start())
    started.set()
    return query[0]


def _ms(at) -> int:
    return int(round(at * 1000))


class Leases(_Keyed):
    """Silence of a run for so many intervals, by event time."""

    schema, empty = "last long, done boolean, asked boolean, ran boolean", (None, False, False, False)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, done, asked, ran, timer = self.load()
        for r in rows:
            last = max(last or 0, _ms(r["at"]))
            done, asked, ran = done or r["event_type"] in TERMINAL_EVENTS, asked or r["event_type"] == "RUN_CANCELLATION_REQUESTED", ran or r["event_type"] == "RUN_RUNNING"
        self.store([last, done, asked, ran, timer], None if done else last + LEASES * LEASE_SECONDS * 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, done, asked, ran, _ = self.load()
        self.store([last, done, asked, ran, None], None)
        yield Row(run_id=key[0], verdict="cancel" if asked else "interrupt" if ran else "resume", last=last / 1000)


def leases(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """``events(run_id, at, event_type)`` -> ``(run_id, verdict, last)`` once a run without an end has been silent for too long.

    A run that shows up again may be told again.  Events older than the watermark do not count."""
    _stores(events.sparkSession)
    rows = events.withWatermark("at", late).select("run_id", "at", "event_type")
    return _timed(rows, "run_id", Leases(), f"run_id {_kind(events, 'run_id')}, verdict string, last double")


def _timed(rows: DataFrame, key: str, processor: StatefulProcessor, out: str) -> DataFrame:
    seconds = rows.withColumn("_event_time", F.col("at")).withColumn("at", F.col("at").cast("double"))
    return seconds.groupBy(key).transformWithState(processor, out, "Append", "EventTime")


class Throttle(_Keyed):
    """What was told last, and what is held."""

    schema, empty = "last double, phase string, held long, held_at double", (None, None, None, None)

    def __init__(self, interval: float, idle: float):
        self.interval, self.idle = interval, idle

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, phase, held, held_at, timer = self.load()
        for seq, at, name, ended in sorted((r["seq"], r["at"], r["phase"], bool(r["ended"])) for r in rows):
            if held is not None and at - held_at >= self.idle:  # its timer was due, and did not come before this row
                yield Row(run_id=key[0], seq=held)
                last, held, held_at = held_at, None, None
            if last is None or name != phase or at - last >= self.interval or ended:
                if ended and held is not None:
                    yield Row(run_id=key[0], seq=held)
                yield Row(run_id=key[0], seq=seq)
                last, phase, held, held_at = at, name, None, None
            else:
                held, held_at = seq, at
        self.store([last, phase, held, held_at, timer], None if held is None else _ms(held_at + self.idle))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, phase, held, held_at, _ = self.load()
        self.store([last if held is None else held_at, phase, None, None, None], None)
        if held is not None:
            yield Row(run_id=key[0], seq=held)


def throttled(progress: DataFrame, interval: float, idle: float = 60.0, late: str = "0 seconds") -> DataFrame:
    """``progress(run_id, seq, at, phase[, ended])`` -> ``(run_id, seq)`` of what is told: the first, a new phase, what comes ``interval``
    seconds after the last that was told; what is held when ``idle`` seconds pass without another, or when its run ends."""
    _stores(progress.sparkSession)
    ended = F.col("ended") if "ended" in progress.columns else F.lit(False)
    rows = progress.withWatermark("at", late).select("run_id", F.col("seq").cast("long").alias("seq"), "at", "phase", ended.alias("ended"))
    return _timed(rows, "run_id", Throttle(interval, idle), f"run_id {_kind(progress, 'run_id')}, seq long")


class Breaker(_Keyed):
    """The last outcomes and since when the breaker is open."""

    schema, empty = "outcomes string, opened double", ("", None)

    def __init__(self, size: int, least: int, threshold: float, cool: float):
        self.size, self.least, self.threshold, self.cool = size, least, threshold, cool

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        outcomes, opened, timer = self.load()
        for seq, at, failed in sorted((r["seq"], r["at"], r["failed"]) for r in rows):
            if opened is not None and at - opened < self.cool:
                yield Row(key=key[0], seq=seq, refused=True, open=True)
                continue
            if opened is not None:
                outcomes, opened = "", None
            outcomes = (outcomes + ("x" if failed else "."))[-self.size :]
            if len(outcomes) >= self.least and outcomes.count("x") / len(outcomes) > self.threshold:
                opened = at
            yield Row(key=key[0], seq=seq, refused=False, open=opened is not None)
        self.store([outcomes, opened, timer], None if opened is None else _ms(opened + self.cool))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, opened, _ = self.load()
        self.store(["", None, None], None)
        if opened is not None:
            yield Row(key=key[0], seq=None, refused=False, open=False)


def breakers(outcomes: DataFrame, size: int = 10, least: int = 5, threshold: float = 0.8, cool: float = 60.0, late: str = "0 seconds") -> DataFrame:
    """``outcomes(key, seq, at, failed)`` -> ``(key, seq, refused, open)``: the breaker's answer to each call, and a row without
    ``seq`` when it closes again, ``cool`` seconds after it opened, whether or not a call comes."""
    _stores(outcomes.sparkSession)
    rows = outcomes.withWatermark("at", late).select("key", F.col("seq").cast("long").alias("seq"), "at", "failed")
    return _timed(rows, "key", Breaker(size, least, threshold, cool), f"key {_kind(outcomes, 'key')}, seq long, refused boolean, open boolean")
