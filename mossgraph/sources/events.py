"""The event log on disk: validated append and scans."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import validation
from ..operators.workingset import numbered
from . import files

SCHEMA = T.StructType([
    T.StructField("seq", T.LongType(), False), T.StructField("id", T.StringType()), T.StructField("timestamp", T.StringType()), T.StructField("event_type", T.StringType()), T.StructField("event_version", T.IntegerType()),
    T.StructField("run_id", T.StringType()), T.StructField("batch_id", T.StringType()), T.StructField("actor", T.StringType()), T.StructField("entity_id", T.StringType()), T.StructField("payload", T.StringType()), T.StructField("payload_hash", T.StringType()),
])
PAYLOAD_MOST = 1 << 20


class InvalidEvent(ValueError):
    """An event that its codec or its references refuse."""


class StaleLog(RuntimeError):
    """The log has moved on since the caller looked."""


class EventLog:
    """An append-only log as Parquet files, one for each batch, in order of ``seq``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def scan(self, after: int | None = None, event_type: str | None = None, run_id: str | None = None, since: str | None = None, limit: int | None = None) -> DataFrame:
        try:
            rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            rows = self.spark.createDataFrame([], SCHEMA)
        for value, condition in ((after, F.col("seq") > F.lit(after)), (event_type, F.col("event_type") == F.lit(event_type)), (run_id, F.col("run_id") == F.lit(run_id)), (since, F.col("timestamp") >= F.lit(since))):
            if value is not None:
                rows = rows.where(condition)
        rows = rows.orderBy("seq")
        return rows.limit(limit) if isinstance(limit, int) and limit > 0 else rows

    def latest(self) -> int:
        return self.scan().agg(F.max("seq")).first()[0] or 0

    def append(self, events: DataFrame, expected: int, codecs: dict | None = None, references: tuple[str, ...] | None = None) -> int:
        """Append ``events(ord, timestamp, event_type, run_id, actor, entity_id, payload[, event_version])`` in order; all or nothing.

        With ``codecs`` an event of unknown type or version, or with a payload that does not fit, is refused; with ``references``, kinds
        of things, one that refers to a thing that no event before it, in the log or the batch, brought into being.  Rows are
        numbered in parallel by ranges of ``ord`` (a total order) and written in parallel."""
        if self.latest() != expected:
            raise StaleLog(f"the log is at {self.latest()}, not {expected}")
        bad = events.where(F.expr("try_parse_json(payload) is null") | (F.octet_length("payload") > PAYLOAD_MOST) | F.col("event_type").isNull()).limit(1).collect()
        if bad:
            raise ValueError(f"an event cannot be appended: {bad[0]['event_type']}")
        version = F.col("event_version") if "event_version" in events.columns else F.lit(1)
        if codecs is not None:
            wrong = validation.decoded(events.select("event_type", version.alias("version"), "payload"), codecs).where("error is not null").limit(1).collect()
            if wrong:
                raise InvalidEvent(f"{wrong[0]['error']}: {wrong[0]['event_type']}")
        if references is not None:
            placed = numbered(events.select("ord", "event_type", "payload"), "ord").select((F.col("n") + F.lit(expected)).alias("seq"), "event_type", "payload")
            lost = validation.dangling(self.scan().select("seq", "event_type", "payload").unionByName(placed), references).where(F.col("seq") > expected).limit(1).collect()
            if lost:
                raise InvalidEvent(f"EVENT_REFERENCE_INVALID: {lost[0]['event_type']} refers to {lost[0]['kind']} {lost[0]['ref']}")
        claim = f"{self.path}_claims/{expected}"
        if not files.create_once(self.spark, claim):  # of two writers that saw the same place one alone goes on
            raise StaleLog(f"another writer appends after {expected}")
        try:
            ranked = numbered(events, "ord").withColumnRenamed("n", "_n")
            base = ranked.select(
                (F.col("_n") + F.lit(expected)).alias("seq"), F.sha2(F.concat_ws("|", F.lit(str(expected)), F.col("_n").cast("string")), 256).substr(1, 26).alias("id"), "timestamp", "event_type", version.cast("int").alias("event_version"), "run_id",
                F.lit(f"batch-{expected}").alias("batch_id"), "actor", "entity_id", "payload", F.sha2(F.col("payload").cast("binary"), 256).alias("payload_hash"),
            )
            base.write.mode("append").parquet(self.path)
        except Exception:
            files.remove(self.spark, claim)
            raise
        return self.latest()

    def corrupt(self) -> DataFrame:
        """Events whose payload is not what its hash says."""
        return self.scan().where(F.sha2(F.col("payload").cast("binary"), 256) != F.col("payload_hash"))


def canonical(value: object) -> str:
    """JSON with sorted keys and whole numbers without a point; what JSON cannot say is an error."""

    def plain(v: object) -> object:
        if isinstance(v, float):
            if v != v or v in (float("inf"), float("-inf")):
                raise ValueError("not a JSON number")
            return int(v) if v == int(v) and abs(v) < 2**53 else v
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
