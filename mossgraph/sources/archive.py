"""Digests of the log by blocks, export and backup with a manifest, restore, snapshots and read-model upkeep."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.projection import checksum
from . import files

BLOCK = 100_000


def lines(log: DataFrame) -> DataFrame:
    """``(block, seq, line)``: each event as JSON with its keys in order."""
    names = sorted(log.columns)
    return log.select(F.floor(F.col("seq") / BLOCK).cast("long").alias("block"), "seq", F.to_json(F.struct(*names)).alias("line"))


def block_digests(log: DataFrame) -> DataFrame:
    """``(block, n, last_seq, sha256)`` of the lines of each block of BLOCK places, newline after each, in order of ``seq``.

    A block is read as a stream by one task; blocks are of fixed size, so a longer log has more of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, n, last = None, None, 0, 0

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], ["block", "n", "last_seq", "sha256"])

        for batch in batches:
            done = []
            for block, seq, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != current:
                    if current is not None:
                        done.append((current, n, last, digest.hexdigest()))
                    current, digest, n = block, hashlib.sha256(), 0
                digest.update(line.encode("utf-8") + b"\n")
                n, last = n + 1, seq
            yield out(done)
        if current is not None:
            yield out([(current, n, last, digest.hexdigest())])

    return lines(log).repartition("block").sortWithinPartitions("block", "seq").mapInArrow(run, "block long, n long, last_seq long, sha256 string")


def manifest_of(log: DataFrame) -> dict:
    """Count, last place and one digest over the blocks' digests; one short row a block reaches the driver."""
    rows = block_digests(log).orderBy("block").collect()
    digest = hashlib.sha256("".join(r["sha256"] for r in rows).encode()).hexdigest()
    return {"count": sum(r["n"] for r in rows), "latestSeq": max((r["last_seq"] for r in rows), default=0), "sha256": digest, "blocks": {str(r["block"]): r["sha256"] for r in rows}}


def export(log: DataFrame, folder: str) -> dict:
    """The log as text files by block and a manifest; an existing folder is refused; without its manifest it does not count."""
    spark = log.sparkSession
    if files.exists(spark, folder):
        raise FileExistsError(folder)
    lines(log).repartition("block").sortWithinPartitions("block", "seq").select("block", F.col("line").alias("value")).write.partitionBy("block").text(f"{folder}/events")
    manifest = manifest_of(log)
    files.write_text(spark, f"{folder}/manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest


def backup(log: DataFrame, views: dict[str, DataFrame], folder: str, versions: dict[str, int]) -> dict:
    """An export with the versions of what reads it and the checksums of the views at that time."""
    manifest = export(log, folder) | {"versions": versions, "checksums": {name: checksum(view) for name, view in views.items()}}
    files.write_text(log.sparkSession, f"{folder}/manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest


class BadBackup(ValueError):
    """A backup that is not what its manifest says."""


def restore(spark: SparkSession, folder: str, schema: str, rebuild: Callable[[DataFrame], dict[str, DataFrame]], target: str) -> dict[str, DataFrame]:
    """Check a backup, rebuild its views twice, and put the log at ``target``.

    Raises if the manifest is missing or differs from the events, or the two rebuilds differ from each other or from the
    checksums in the manifest; ``target`` is written only after all checks and must not exist."""
    text = files.read_text(spark, f"{folder}/manifest.json")
    if text is None:
        raise BadBackup("no manifest")
    manifest = json.loads(text)
    if files.exists(spark, target):
        raise FileExistsError(target)
    log = spark.read.text(f"{folder}/events").select(F.from_json("value", schema).alias("e")).select("e.*")
    found = manifest_of(log)
    for name in ("count", "latestSeq", "sha256"):
        if found[name] != manifest.get(name):
            raise BadBackup(f"{name}: {found[name]} in the events, {manifest.get(name)} in the manifest")
    first, second = ({name: checksum(view) for name, view in rebuild(log).items()} for _ in range(2))
    if first != second or "checksums" in manifest and first != manifest["checksums"]:
        raise BadBackup("the views differ")
    log.write.parquet(target)
    return rebuild(spark.read.parquet(target))


# --- snapshots ---


def snapshots(spark: SparkSession, folder: str) -> list[dict]:
    return json.loads(files.read_text(spark, f"{folder}/manifest.json") or "[]")


def take_snapshot(views: dict[str, DataFrame], folder: str, cursor: int, version: int, keep: int = 3) -> dict:
    """Views at ``cursor`` as Parquet; the same cursor and checksums are not written twice; the latest ``keep`` stay."""
    spark = next(iter(views.values())).sparkSession
    known = snapshots(spark, folder)
    sums = {name: checksum(view) for name, view in views.items()}
    for entry in known:
        if entry["cursor"] == cursor and entry["checksums"] == sums and entry["version"] == version:
            return entry
    entry = {"cursor": cursor, "version": version, "checksums": sums, "valid": True, "views": {name: f"{folder}/{cursor}-{version}/{name}" for name in views}}
    for name, view in views.items():
        view.write.mode("overwrite").parquet(entry["views"][name])
    known = [e for e in known if (e["cursor"], e["version"]) != (cursor, version)] + [entry]
    for old in known[:-keep]:
        files.remove(spark, f"{folder}/{old['cursor']}-{old['version']}")
    files.write_text(spark, f"{folder}/manifest.json", json.dumps(known[-keep:]))
    return entry


def latest_snapshot(spark: SparkSession, folder: str, version: int, at_most: int | None = None) -> dict | None:
    """The valid snapshot of ``version`` with the highest cursor, no higher than ``at_most``."""
    fit = [e for e in snapshots(spark, folder) if e["valid"] and e["version"] == version and (at_most is None or e["cursor"] <= at_most)]
    return max(fit, key=lambda e: e["cursor"], default=None)


def invalidate(spark: SparkSession, folder: str) -> None:
    """No snapshot counts any more; views are rebuilt from the first event on."""
    files.write_text(spark, f"{folder}/manifest.json", json.dumps([e | {"valid": False} for e in snapshots(spark, folder)]))


def refreshed(stored: DataFrame, delta: DataFrame, key: str = "id", seq: str = "last_seq") -> DataFrame:
    """A last-writer view at a snapshot with the same view of the events since: the later row of each key, its nulls filled."""
    names = [c for c in stored.columns if c not in (key, seq)]
    both = stored.unionByName(delta.select(stored.columns))
    return both.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in names], F.max(seq).alias(seq))


# --- the read model kept up to date ---

# The view that an event changes, and where its id stands; curation and rollback change any.
IMPACT = {
    "NODE_ADDED": ("entities", "id"), "NODE_RELABELED": ("entities", "targetId"), "NODE_METADATA_UPDATED": ("entities", "targetId"), "FAMILY_CREATED": ("families", "family_id"), "FAMILY_RENAMED": ("families", "targetId"),
    "FAMILY_RESOLVED": ("families", "familyId"), "THREAD_CREATED": ("threads", "threadId"), "THREAD_RESOLVED": ("threads", "threadId"), "CONTRADICTION_IDENTIFIED": ("contradictions", "id"), "CONTRADICTION_RESOLVED": ("contradictions", "contradictionId"),
    "GAP_OPENED": ("gaps", "id"), "GAP_RESOLVED": ("gaps", "gapId"), "SOURCE_ADDED": ("sources", "id"), "EVIDENCE_LINKED": ("evidence", "id"), "CLAIM_ACCEPTED": ("claims", "id"),
}
DIRTYING = ("CLAIM_MERGED", "CLAIM_SPLIT", "CLAIM_RETRACTION_SET", "CLAIM_RELATION_CURATED", "EVIDENCE_STANCE_OVERRIDDEN", "RUN_ROLLED_BACK", "ENTITY_MERGED", "ENTITY_SPLIT", "FAMILY_MERGED")


def affected(events: DataFrame) -> DataFrame:
    """``(view, id)``: rows that these events change; ``(dirty, null)`` where only a rebuild will do."""
    value = F.try_parse_json("payload")
    view, key = F.when(F.col("event_type").isin(*DIRTYING), F.lit("dirty")), F.lit(None).cast("string")
    for kind, (name, path) in IMPACT.items():
        view = view.when(F.col("event_type") == kind, F.lit(name))
        key = F.when(F.col("event_type") == kind, F.try_variant_get(value, f"$.{path}", "string")).otherwise(key)
    return events.select(view.alias("view"), key.alias("id")).where("view is not null").distinct()


def upserted(stored: DataFrame, derived: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """``stored`` with the rows of ``ids`` taken from ``derived``; rows that are no longer derived go."""
    return stored.join(ids, key, "left_anti").unionByName(derived.join(ids, key, "left_semi").select(stored.columns))


def serialised(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Rows of the read model: defaults for absent values, and the whole row as JSON without nulls."""
    filled = rows.withColumns({name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()})
    return filled.withColumn("row_json", F.to_json(F.struct(*sorted(filled.columns))))


def step_checkpoints(writes: DataFrame, newest_format: int) -> DataFrame:
    """``writes(run_id, ord, deleted, format, body)`` -> the last checkpoint of each run, unless it is deleted.

    Formats newer than ``newest_format`` and bodies that are not JSON are not read: such a run has none."""
    last = writes.groupBy("run_id").agg(F.max_by(F.struct("deleted", "format", "body"), "ord").alias("w")).select("run_id", "w.*")
    return last.where(~F.col("deleted") & (F.col("format") <= newest_format) & F.try_parse_json("body").isNotNull()).select("run_id", "format", "body")
