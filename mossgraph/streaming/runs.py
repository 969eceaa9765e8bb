"""Structured Streaming: the run ledger with state for each run, and views kept up to date batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ledger import next_state
from ..sources import files

OUT = "run_id long, status string, applied long, illegal long"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, applied, illegal, last = state.get if state.exists else ("none", 0, 0, -1)
    rows = pd.concat(list(batches)).sort_values("seq")  # one run's events of one micro-batch
    for seq, event_type in zip(rows["seq"], rows["event_type"], strict=True):
        to = None if seq <= last else next_state(status, event_type)
        if to is None:
            illegal += 1
        else:
            status, applied = to, applied + 1
        last = max(last, int(seq))
    state.update((status, applied, illegal, last))
    yield pd.DataFrame([(key[0], status, applied, illegal)], columns=["run_id", "status", "applied", "illegal"])


def ledger_stream(events: DataFrame) -> DataFrame:
    """Each run's state after every micro-batch of ``events(run_id, seq, event_type)``; late events are illegal ones."""
    return events.groupBy("run_id").applyInPandasWithState(_fold, OUT, "status string, applied long, illegal long, last long", "update", GroupStateTimeout.NoTimeout)


def keep_latest(stream: DataFrame, table: str, key: str, checkpoint: str) -> StreamingQuery:
    """Upsert every micro-batch into a Parquet table, two versions in turn (``latest_of`` reads the last); run until the input is used up."""

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = None
        if number:
            before = spark.read.schema(batch.schema).parquet(f"{table}/v{(number - 1) % 2}")
        new = batch if before is None else before.join(batch.select(key), key, "left_anti").unionByName(batch)
        new.write.mode("overwrite").parquet(f"{table}/v{number % 2}")
        files.write_text(spark, f"{table}/last", str(number % 2))

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(upsert).trigger(availableNow=True).start()


def latest_of(spark: SparkSession, table: str) -> DataFrame:
    """What ``keep_latest`` has kept as of its last micro-batch."""
    return spark.read.parquet(f"{table}/v{files.read_text(spark, f'{table}/last')}")


def windowed_failures(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Failures by window of event time, with a watermark for late events."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w")).agg(F.count_if(F.col("event_type") == "RUN_FAILED").alias("failed"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "failed", "n")


def drain(query: StreamingQuery, then: Callable[[], DataFrame]) -> DataFrame:
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return then()
