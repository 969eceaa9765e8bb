"""Views derived from the event log set-wise: rollback first, then first and last writers, tombstones and aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components

# What happens to a run's events of each type when the run is rolled back.
AUDIT_ONLY = (
    "RUN_STARTED RUN_COMPLETED RUN_FAILED PROJECTION_REBUILT CLAIM_EXTRACTED EXTRACTION_FAILED RUN_ROLLED_BACK SYNTHESIS_COMPLETED RUN_CANCELLED RUN_QUEUED "
    "RUN_STARTING RUN_RUNNING RUN_PROGRESS RUN_HEARTBEAT RUN_CANCELLATION_REQUESTED RUN_INTERRUPTED"
).split()
CROSS_RUN = (
    "NODE_RELABELED NODE_METADATA_UPDATED EXTRACTION_CONFIDENCE_REVISED RELATIONSHIP_STRENGTH_REVISED ENTITY_MERGED ENTITY_SPLIT SOURCE_CHANGED SOURCE_RETRACTED "
    "FAMILY_RELATION_REMOVED FAMILY_RENAMED FAMILY_MERGED CONTRADICTION_RESOLVED GAP_RESOLVED CLAIM_MERGED CLAIM_SPLIT CLAIM_RETRACTION_SET CLAIM_RELATION_CURATED EVIDENCE_STANCE_OVERRIDDEN"
).split()


def rollback_class(event_type: Column) -> Column:
    return F.when(event_type.isin(*AUDIT_ONLY), F.lit("audit_only")).when(event_type.isin(*CROSS_RUN), F.lit("cross_run_mutation")).when(event_type == "EDGE_REMOVED", F.lit("dynamic_edge")).otherwise(F.lit("pure_run_local"))


def payload(name: str, kind: str = "string") -> Column:
    """A field of the JSON payload."""
    return F.expr(f"try_variant_get(parse_json(payload), '$.{name}', '{kind}')")


def live_events(log: DataFrame) -> DataFrame:
    """Events that count: no audit events, no local events of rolled-back runs, no removal of such a run's own edges.

    ``log(seq, run_id, event_type, payload)``.  Rolled-back runs are those of the whole history."""
    rolled = log.where("event_type = 'RUN_ROLLED_BACK'").select(payload("run_id").alias("_run")).distinct()
    marked = log.withColumn("_class", rollback_class(F.col("event_type"))).where("_class <> 'audit_only'")
    flagged = marked.join(rolled.withColumn("_rolled", F.lit(True)), marked["run_id"] == F.col("_run"), "left").drop("_run")
    edges = log.where("event_type = 'EDGE_ADDED'").select(payload("id").alias("_edge"), F.col("run_id").alias("_edge_run")).distinct()
    removal = F.when(F.col("_class") == "dynamic_edge", payload("edgeId"))
    known = flagged.withColumn("_removes", removal).join(edges, (F.col("_removes") == F.col("_edge")) & (F.col("run_id") == F.col("_edge_run")), "left")
    gone = F.col("_rolled").isNotNull() & ((F.col("_class") == "pure_run_local") | ((F.col("_class") == "dynamic_edge") & F.col("_edge").isNotNull()))
    return known.where(~F.coalesce(gone, F.lit(False))).select(*log.columns)


def last_writer(events: DataFrame, key: Column, **values: Column) -> DataFrame:
    """One row a key with the last non-null value of each column by ``seq``."""
    rows = events.select(key.alias("id"), "seq", *[v.alias(k) for k, v in values.items()]).where("id is not null")
    return rows.groupBy("id").agg(*[F.max_by(F.col(k), F.when(F.col(k).isNotNull(), F.col("seq"))).alias(k) for k in values], F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def sources(events: DataFrame) -> DataFrame:
    """The first observation gives the fields; later ones count and move ``last_seen_at``; readings and retractions overlay."""
    seen = events.where("event_type = 'SOURCE_OBSERVED'").select(payload("sourceId").alias("id"), "seq", "run_id", payload("url").alias("url"), payload("domain").alias("domain"), payload("authorityClass").alias("authority"), payload("observedAt").alias("at"))
    base = seen.groupBy("id").agg(
        F.min_by("url", "seq").alias("url"), F.min_by("domain", "seq").alias("domain"), F.min_by("authority", F.when(F.col("authority").isNotNull(), F.col("seq"))).alias("authority"),
        F.count("*").alias("run_count"), F.min_by("at", "seq").alias("first_seen_at"), F.max_by("at", "seq").alias("last_seen_at"),
    )
    later = events.where("event_type in ('SOURCE_READ', 'SOURCE_CHANGED', 'SOURCE_RETRACTED')").select(payload("sourceId").alias("id"), "seq", "event_type", payload("contentHash").alias("hash"))
    over = later.groupBy("id").agg(F.max_by("hash", F.when(F.col("hash").isNotNull(), F.col("seq"))).alias("content_hash"), F.bool_or(F.col("event_type") == "SOURCE_RETRACTED").alias("retracted"))
    return base.join(over, "id", "left").withColumn("retracted", F.coalesce("retracted", F.lit(False)))


def edges(events: DataFrame) -> DataFrame:
    """Relations whose last event adds them; self-loops are skipped."""
    rows = events.where("event_type in ('EDGE_ADDED', 'EDGE_REMOVED')").select(
        F.coalesce(payload("id"), payload("edgeId")).alias("id"), "seq", (F.col("event_type") == "EDGE_ADDED").alias("there"), payload("fromClaimId").alias("from_id"), payload("toClaimId").alias("to_id"), payload("relation").alias("relation")
    )
    w = Window.partitionBy("id").orderBy(F.col("seq").desc())
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1 and there and from_id <> to_id").select("id", "from_id", "to_id", "relation")


def survivors(events: DataFrame, event_type: str, gone: str, into: str) -> DataFrame:
    """``(id, survivor)`` after all merges, chains included: who is merged points to the one that is not; a cycle to its least."""
    from .knowledge import aliases

    merges = events.where(F.col("event_type") == event_type).select(payload(gone).alias("id"), payload(into).alias("to"))
    return aliases(merges).withColumnRenamed("to", "survivor")


def claims(events: DataFrame) -> DataFrame:
    """Claims by founding observation, with counts of observations and evidence, last sight and expiry, merges applied."""
    seen = events.where("event_type = 'CLAIM_OBSERVED'").select(payload("claimId").alias("raw"), "seq", payload("familyId").alias("family_id"), payload("subject").alias("subject"), payload("observedAt").alias("at"))
    alias = survivors(events, "CLAIM_MERGED", "claimId", "intoClaimId")
    named = lambda rows: rows.join(alias.withColumnRenamed("id", "raw"), "raw", "left").withColumn("id", F.coalesce("survivor", "raw")).drop("survivor")
    base = named(seen).groupBy("id").agg(
        F.min_by("family_id", "seq").alias("family_id"), F.min_by("subject", F.struct(F.col("raw") != F.col("id"), F.col("seq"))).alias("subject"), F.count("*").alias("n_observations"), F.max("at").alias("last_seen_at"),
    )
    e = events.where("event_type = 'EVIDENCE_LINKED'").select(payload("id").alias("evidence"), "seq", payload("claimId").alias("raw"), payload("stance").alias("stance"))
    latest = e.groupBy("evidence").agg(F.max_by("raw", "seq").alias("raw"), F.max_by("stance", "seq").alias("stance"))
    linked = named(latest).groupBy("id").agg(F.count_if(F.col("stance") == "supports").alias("n_supports"), F.count_if(F.col("stance") == "opposes").alias("n_opposes"))
    expired = events.where("event_type = 'CLAIM_EXPIRED'").select(payload("claimId").alias("id"), payload("expiredAt").alias("x"), "seq").groupBy("id").agg(F.max_by("x", "seq").alias("expired_at"))
    out = base.join(linked, "id", "left").join(expired, "id", "left")
    return out.withColumns({"n_supports": F.coalesce("n_supports", F.lit(0)), "n_opposes": F.coalesce("n_opposes", F.lit(0))})


def rebuilt(log: DataFrame) -> dict[str, DataFrame]:
    """All views from the log."""
    events = live_events(log)
    return {"claims": claims(events), "sources": sources(events), "edges": edges(events)}


def checksum(view: DataFrame) -> str:
    """A digest of a view that does not depend on the order of its rows: 128 bits summed by halves."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(view.columns)))).cast("decimal(38,0)")
    other = F.xxhash64(F.lit("second"), F.to_json(F.struct(*sorted(view.columns)))).cast("decimal(38,0)")
    a, b, n = view.agg(F.sum(row), F.sum(other), F.count("*")).first()
    return f"{int(a or 0) % 2**64:016x}{int(b or 0) % 2**64:016x}-{n}"


def duplicate_groups(merges: DataFrame) -> DataFrame:
    """Groups of ids that merge events tie together in any order."""
    return components(merges)
