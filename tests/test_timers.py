"""Streams with timers against their batch forms, over several micro-batches."""

import datetime

import pytest
from pyspark.sql import functions as F

from mossgraph.operators import feeds, ledger
from mossgraph.streaming import timers

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
at = lambda s: T0 + datetime.timedelta(seconds=s)


def stream_of(spark, folder, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drained(spark, frame, folder):
    query = frame.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(200) and query.exception() is None
    return [tuple(r) for r in spark.read.schema(frame.schema).parquet(f"{folder}/out").collect()]


EVENTS = "run_id string, seq long, event_type string"


def test_a_backlog_of_any_size_is_told_in_pages_and_the_end_stops_the_query(spark, tmp_path):
    kinds = ["RUN_STARTED", *["RUN_PROGRESS"] * 248, "RUN_COMPLETED", "RUN_PROGRESS"]
    rows = [("r1", k, kind) for k, kind in enumerate(kinds)] + [("r2", 1000 + k, "RUN_PROGRESS") for k in range(50)]
    stream = stream_of(spark, f"{tmp_path}/in", [rows[::-1]], EVENTS)
    pages = []
    query = timers.tail(stream, "r1", -1, f"{tmp_path}/cp", pages.append, processingTime="1 second")
    assert query.awaitTermination(120) and query.exception() is None  # stopped by the run's end
    assert [len(p) for p in pages] == [100, 100, 50] and [s for p in pages for s, _ in p] == list(range(250)) and pages[-1][-1][1] == "RUN_COMPLETED"


def test_the_cursor_outlives_the_query(spark, tmp_path):
    told = []
    first = stream_of(spark, f"{tmp_path}/in", [[("r", k, "RUN_PROGRESS") for k in range(5, 15)]], EVENTS)
    timers.tail(first, "r", 6, f"{tmp_path}/cp", told.extend, availableNow=True).awaitTermination(100)
    again = stream_of(spark, f"{tmp_path}/in", [[("r", k, "RUN_PROGRESS") for k in (8, 9, 15, 16)], [("r", 17, "RUN_FAILED")], [("r", 18, "RUN_PROGRESS")]], EVENTS)
    timers.tail(again, "r", 6, f"{tmp_path}/cp", told.extend, availableNow=True).awaitTermination(100)
    assert [s for s, _ in told if s is not None] == list(range(7, 18))


def test_silence_brings_heartbeats_and_a_lifetime_ends(spark, tmp_path):
    told = []
    stream = stream_of(spark, f"{tmp_path}/in", [[("r", 1, "RUN_STARTED")]], EVENTS)
    query = timers.tail(stream, "r", 0, f"{tmp_path}/cp", told.extend, heartbeat=500, lifetime=12_000, processingTime="200 milliseconds")
    assert query.awaitTermination(120) and query.exception() is None
    kinds = [k for _, k in told]
    assert kinds[0] == "RUN_STARTED" and "HEARTBEAT" in kinds and kinds[-1] == "LIFETIME_OVER"


def test_all_runs_up_to_their_ends(spark, tmp_path):
    rows = [(f"r{k % 7}", k, "RUN_COMPLETED" if k in (30, 45, 200) else "RUN_PROGRESS") for k in range(300)]
    stream = stream_of(spark, f"{tmp_path}/in", [rows[:100][::-1], rows[100:220], rows[220:]], EVENTS)
    got = drained(spark, timers.tails(stream, 10), str(tmp_path))
    want = feeds.until_terminal(spark.createDataFrame(rows, EVENTS), 10).select("run_id", "seq", "event_type")
    assert sorted(got) == sorted(map(tuple, want.collect()))


def test_a_lease_that_goes_silent_fires(spark, tmp_path):
    schema = "run_id string, at timestamp, event_type string"
    batches = [
        [("a", at(0), "RUN_RUNNING"), ("b", at(0), "RUN_QUEUED"), ("c", at(1), "RUN_RUNNING"), ("d", at(2), "RUN_RUNNING"), ("e", at(3), "RUN_RUNNING")],
        [("c", at(5), "RUN_CANCELLATION_REQUESTED"), ("d", at(40), "RUN_COMPLETED"), ("e", at(58), "RUN_HEARTBEAT")],
        [("e", at(100), "RUN_HEARTBEAT")], [("e", at(150), "RUN_HEARTBEAT"), ("f", at(151), "RUN_RUNNING")], [("z", at(152), "RUN_COMPLETED")],
    ]
    got = drained(spark, timers.leases(stream_of(spark, f"{tmp_path}/in", batches, schema)), str(tmp_path))
    assert sorted((r, v) for r, v, _ in got) == [("a", "interrupt"), ("b", "resume"), ("c", "cancel")]
    log = spark.createDataFrame([r for b in batches for r in b], schema)
    want = feeds.leases(log, F.lit(at(152))).where("verdict <> 'alive'")
    assert sorted((r, v) for r, v, _ in got) == sorted(map(tuple, want.collect()))


def test_held_progress_is_told_by_a_timer_and_all_else_as_in_a_fold(spark, tmp_path):
    schema = "run_id long, seq long, at timestamp, phase string"
    rows = [(k % 3, k, at(k * 3 + (k % 5)), "abc"[k // 20 % 3]) for k in range(90)]
    batches = [rows[:20], rows[20:50], rows[50:], [(9, 1000, at(5000), "x")]]
    got = drained(spark, timers.throttled(stream_of(spark, f"{tmp_path}/in", batches, schema), 25.0, idle=600.0), str(tmp_path))
    frame = spark.createDataFrame([r for b in batches for r in b], schema)
    assert sorted(got) == sorted(map(tuple, feeds.throttled(frame, 25.0).collect()))
    quick = f"{tmp_path}/quick"
    held = [[(1, 1, at(0), "a"), (1, 2, at(1), "a")], [(2, 3, at(30), "a")], [(1, 4, at(31), "a"), (2, 5, at(32), "a")], [(3, 6, at(33), "a")]]
    got = drained(spark, timers.throttled(stream_of(spark, f"{quick}/in", held, schema), 100.0, idle=10.0), quick)
    assert sorted(got) == [(1, 1), (1, 2), (2, 3), (3, 6)]  # 2 by timer; 4 and 5 are still held
    ended = f"{tmp_path}/ended"
    rows = [[(1, 1, at(0), "a", False), (1, 2, at(1), "a", False)], [(1, 3, at(2), "a", True)]]
    got = drained(spark, timers.throttled(stream_of(spark, f"{ended}/in", rows, schema + ", ended boolean"), 100.0), ended)
    assert sorted(got) == [(1, 1), (1, 2), (1, 3)]


@pytest.mark.parametrize("cool", [20.0, 200.0])
def test_a_breaker_closes_by_a_timer_and_answers_as_in_a_fold(spark, tmp_path, cool):
    schema = "key long, seq long, at timestamp, failed boolean"
    rows = [(k % 2, k, at(k * 2), k % 11 != 0) for k in range(120)]
    batches = [rows[:40], rows[40:80], rows[80:], [(7, 9999, at(10_000), False)]]
    got = drained(spark, timers.breakers(stream_of(spark, f"{tmp_path}/in", batches, schema), cool=cool), str(tmp_path))
    frame = spark.createDataFrame([r for b in batches for r in b], schema)
    want = [tuple(r) for r in ledger.breaker_states(frame, cool=cool).collect()]
    assert sorted(r for r in got if r[1] is not None) == sorted(want)
    closed = [r for r in got if r[1] is None]
    assert (closed or cool < 200) and all(not r[3] for r in closed)
