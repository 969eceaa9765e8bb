"""The read model kept up to date by a stream of events: views that ``incremental`` has no facts for, derived anew where they change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.archive import affected, upserted


def maintained(events: DataFrame, log: Callable[[], DataFrame], rebuild: Callable[[DataFrame], dict[str, DataFrame]], folder: str, checkpoint: str) -> StreamingQuery:
    """Views under ``folder`` brought up to each micro-batch of ``events``: only the rows that its events change are replaced.

    A batch with an event that may change any row rebuilds all views.  ``log()`` reads all events so far.  A batch writes a
    version of its own, so one that is run again after a failure replaces what it wrote; ``latest`` finds the last."""

    def update(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        changed = affected(batch).persist()
        dirty = not changed.where("view = 'dirty'").isEmpty()
        for name, derived in rebuild(log()).items():
            ids = changed.where(F.col("view") == name).select("id")
            before = latest(spark, folder, name, number)
            view = derived if dirty or before is None else upserted(before, derived, ids)
            view.write.mode("overwrite").parquet(f"{folder}/{name}/v{number}")
        changed.unpersist()
        batch.unpersist()

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(update).trigger(availableNow=True).start()


def latest(spark, folder: str, name: str, before: int | None = None) -> DataFrame | None:
    """The last version of a view, or the last before a batch."""
    from ..sources import files

    number = (before - 1) if before is not None else 0
    if before is None:
        while files.exists(spark, f"{folder}/{name}/v{number + 1}/_SUCCESS"):
            number += 1
    path = f"{folder}/{name}/v{number}"
    return spark.read.parquet(path) if number >= 0 and files.exists(spark, f"{path}/_SUCCESS") else None
