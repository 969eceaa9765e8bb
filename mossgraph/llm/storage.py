"""Where long jobs cut their lineage: Parquet tables in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more rows than this, or than a 100,000th of all, is dealt out over several tasks.
HOT = 10_000


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; without one, a local folder in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="mossgraph-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(frame: DataFrame) -> DataFrame:
    """Write ``frame`` to the shared folder and read it again: its lineage ends there and lost executors cost nothing."""
    spark = frame.sparkSession
    path = f"{scratch_folder(spark)}/mossgraph/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    again = spark.read.schema(frame.schema).parquet(path)
    again.scratch_path = path
    return again


def discard(*frames: DataFrame | None) -> None:
    """Delete what ``written`` wrote for ``frames``, once all that reads them has been written itself."""
    for frame in frames:
        if frame is not None and (path := getattr(frame, "scratch_path", None)):
            session = frame.sparkSession
            folder = session._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(session._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of ``rows`` rows at most for what is written within, where rows are wide."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def set_aside(frame: DataFrame, names: set[str]) -> tuple[DataFrame, dict[str, str]]:
    """``frame`` with columns called like ``names`` renamed, and how to call them again."""
    back = {f"own {c}": c for c in frame.columns if c in names}
    return frame.select([frame[f"`{c}`"].alias(f"own {c}") if c in names else frame[f"`{c}`"] for c in frame.columns]), back


def hot_join(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, spread: Column) -> DataFrame:
    """``rows`` joined with ``groups``, a written table of one row a key with how many ``rows`` have it in ``count``.

    Rows of hot keys are dealt out by ``spread``, so that no task gets them all; their row of ``groups`` is repeated."""
    total, largest = groups.agg(F.sum(count), F.max(count)).first()
    least = max(HOT, (total or 0) // 100_000)
    salts = -(-(largest or 0) // least)
    if salts < 2:
        return rows.join(groups.drop(count), keys)
    hot = F.broadcast(groups.where(F.col(count) > least).select(*keys, F.lit(True).alias("_hot")))  # 100,000 rows at most
    dealt = rows.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))).drop("_hot")
    many = F.when(F.col(count) > least, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(groups.withColumn("_salt", F.explode(many)).drop(count), [*keys, "_salt"]).drop("_salt")
