"""Scans of one key in blocks against a walk through its rows; a key with a third of all rows is in many ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mossgraph.operators import ledger, scan


def log_of(n, seed, runs=9):
    """A third of all events are of run 0; sequence numbers of runs interleave."""
    rng = random.Random(seed)
    kinds = [*ledger.TRANSITIONS, "OTHER", None]
    lively = ["RUN_QUEUED", "RUN_STARTING", "RUN_RUNNING", *["RUN_PROGRESS"] * 9, "RUN_HEARTBEAT"]
    return [(0 if k % 3 == 0 else rng.randrange(1, runs), k, rng.choice(lively if rng.random() < 0.9 else kinds)) for k in range(n)]


def walked(rows):
    out = {}
    for run, _, kind in sorted(rows, key=lambda r: r[1]):
        status, applied, illegal = out.get(run, ("none", 0, 0))
        to = ledger.next_state(status, kind)
        out[run] = (to or status, applied + (to is not None), illegal + (to is None))
    return sorted((run, *x) for run, x in out.items())


SCHEMA = "run_id long, seq long, event_type string"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_run_folded_in_blocks(spark, seed):
    rows = log_of(3000, seed)
    got = ledger.folded_runs(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert sorted(map(tuple, got.collect())) == walked(rows)
    assert ledger.folded_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_run_with_a_third_of_the_log_is_in_many_ranges(spark):
    rows = spark.createDataFrame(log_of(3000, 4), SCHEMA).repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        sizes = scan.in_ranges(rows, "run_id", "seq").groupBy("_range").agg(F.count("*").alias("n"), F.count_if(F.col("run_id") == 0).alias("hot")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(r.hot for r in sizes) == 1000 and max(r.hot for r in sizes) < 500 and max(r.n for r in sizes) < 700


def test_maps_compose_as_they_are_applied(seed=5):
    rng = np.random.default_rng(seed)
    for n in (1, 2, 3, 17, 64):
        to, applied = rng.integers(0, 6, (n, 6)), rng.integers(0, 2, (n, 6))
        end, count = scan.composed(to, applied)
        for s in range(6):
            at, total = s, 0
            for k in range(n):
                total += applied[k, at]
                at = to[k, at]
            assert (end[0, s], count[0, s]) == (at, total)


def test_running_sums_and_sliding_windows_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 16)
    rows = log_of(700, 6)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = ledger.spent(frame, "RUN_PROGRESS", 5)
    sums, want = {}, []
    for run, seq, kind in rows:
        sums[run] = sums.get(run, 0) + (kind == "RUN_PROGRESS")
        want.append((run, seq, sums[run], sums[run] >= 5))
    assert sorted(map(tuple, got.collect())) == sorted(w for w in want)
    outcomes = frame.select(F.col("run_id").alias("key"), "seq", (F.pmod(F.xxhash64("seq"), F.lit(10)) < 8).alias("failed"))
    failed = {r.seq: r.failed for r in outcomes.collect()}
    seen, want = {}, []
    for run, seq, _ in rows:
        seen.setdefault(run, []).append(failed[seq])
        last = seen[run][-10:]
        rate = sum(last) / len(last)
        want.append((run, seq, round(rate, 6), len(last), len(last) >= 5 and rate > 0.8))
    assert sorted(map(tuple, ledger.failure_windows(outcomes).collect())) == sorted(want)


def test_components_with_hubs_dealt_out(spark, monkeypatch):
    from mossgraph.operators import graph

    monkeypatch.setattr(graph, "HUB", 5)
    rng = random.Random(3)
    edges = [(0, k) for k in range(1, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(k, k + 1) for k in range(200, 230)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
