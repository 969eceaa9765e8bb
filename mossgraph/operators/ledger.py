"""Lives of runs: the state machine, failure windows, progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scan

# The state that an event leads to from each state.
TRANSITIONS: dict[str, dict[str, str]] = {
    "RUN_QUEUED": {"none": "queued"}, "RUN_STARTING": {"queued": "starting"}, "RUN_RUNNING": {"starting": "running"},
    "RUN_CANCELLATION_REQUESTED": {"queued": "cancelling", "starting": "cancelling", "running": "cancelling"},
    "RUN_CANCELLED": {"cancelling": "cancelled"}, "RUN_FAILED": {"queued": "failed", "starting": "failed", "running": "failed"},
    "RUN_COMPLETED": {"running": "completed"}, "RUN_INTERRUPTED": {"starting": "interrupted", "running": "interrupted"},
    "RUN_ROLLED_BACK": {"completed": "rolled_back", "failed": "rolled_back", "cancelled": "rolled_back", "interrupted": "rolled_back"},
    "RUN_STARTED": {"none": "running"}, "RUN_PROGRESS": {"running": "running"}, "RUN_HEARTBEAT": {"starting": "starting", "running": "running", "cancelling": "cancelling"},
}
STATES = ["none", *sorted({to for t in TRANSITIONS.values() for to in t.values()})]
TERMINAL = ("completed", "failed", "cancelled", "interrupted", "rolled_back")


def lifecycle(log: DataFrame, heartbeats: bool = False) -> DataFrame:
    """Events of the life of runs; a feed for readers leaves heartbeats out."""
    kinds = [kind for kind in TRANSITIONS if heartbeats or kind != "RUN_HEARTBEAT"]
    return log.where(F.col("event_type").isin(*kinds))


def next_state(state: str, event_type: str) -> str | None:
    """None for an illegal transition."""
    return TRANSITIONS.get(event_type, {}).get(state)


def latest_state(log: DataFrame) -> DataFrame:
    """Each run's last event and the counts of its kinds, without the legality of the path."""
    return log.groupBy("run_id").agg(
        F.max_by("event_type", "seq").alias("last_event"), F.max("seq").alias("last_seq"), F.count_if(F.col("event_type") == "RUN_FAILED").alias("n_failed"), F.count("*").alias("n_events"),
    )


def folded_runs(log: DataFrame) -> DataFrame:
    """``(run_id, status, applied, illegal)``: the state machine over each run's events in order.

    Illegal events leave the state as it is and are counted.  A run's events are worked on in blocks, each as a map from the
    states before it to those after it, so a run with most of the log is spread over many tasks."""
    return scan.machine(log, "run_id", "seq", "event_type", STATES, TRANSITIONS, "none")


def failure_windows(outcomes: DataFrame, size: int = 10, least: int = 5, threshold: float = 0.8) -> DataFrame:
    """``outcomes(key, seq, failed)`` with the failure rate of the last ``size`` and whether the breaker would open."""
    rows, own = scan.sliding(outcomes, "key", "seq", size)
    w = Window.partitionBy("key", "_block").orderBy("seq").rowsBetween(1 - size, 0)
    rate = F.avg(F.col("failed").cast("double")).over(w)
    n = F.count("*").over(w)
    return rows.select("key", "seq", own.alias("_own"), F.round(rate, 6).alias("rate"), n.alias("n"), ((n >= least) & (rate > threshold)).alias("open")).where("_own").drop("_own")


def spent(log: DataFrame, kind: str, most: int) -> DataFrame:
    """``(run_id, seq, spent, exhausted)``: how many events of ``kind`` each run has had by then, and whether that is ``most``."""
    out = scan.running(log.select("run_id", "seq", "event_type"), "run_id", "seq", F.coalesce((F.col("event_type") == kind).cast("int"), F.lit(0)), "spent")
    return out.select("run_id", "seq", "spent", (F.col("spent") >= most).alias("exhausted"))


def breaker_states(outcomes: DataFrame, size: int = 10, least: int = 5, threshold: float = 0.8, cool: float = 60.0) -> DataFrame:
    """``outcomes(key, seq, at, failed)`` -> ``(key, seq, refused, open)``: a circuit breaker's answer to each call of a key.

    It opens when more than ``threshold`` of the last ``size`` outcomes failed, ``least`` of them at least; while it is open calls are
    refused and do not count; ``cool`` seconds after it opened the next call goes through with an empty window.  What counts
    depends on what was refused before, so each key is a fold over its rows, sorted within partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, window, opened = None, [], None
        for batch in batches:
            out = []
            for key, seq, at, failed in batch.itertuples(index=False):
                if key != current:
                    current, window, opened = key, [], None
                if opened is not None and at - opened < cool:
                    out.append((key, seq, True, True))
                    continue
                if opened is not None:
                    window, opened = [], None
                window = [*window, failed][-size:]
                if len(window) >= least and sum(window) / len(window) > threshold:
                    opened = at
                out.append((key, seq, False, opened is not None))
            yield pd.DataFrame(out, columns=["key", "seq", "refused", "open"])

    rows = outcomes.select("key", "seq", F.col("at").cast("double").alias("at"), "failed").repartition("key").sortWithinPartitions("key", "seq")
    return rows.mapInPandas(run, "key long, seq long, refused boolean, open boolean")
