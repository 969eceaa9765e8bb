"""Taking a run back: which of its effects can be undone, and by what events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .knowledge import of, texts
from .projection import payload, rollback_class

# Events of curation, which are never rolled back.
CURATION = ("CLAIM_MERGED", "CLAIM_SPLIT", "CLAIM_RETRACTION_SET", "CLAIM_RELATION_CURATED", "EVIDENCE_STANCE_OVERRIDDEN")
# Events undone by one of the same type with two fields exchanged.
EXCHANGED = {
    "NODE_RELABELED": ("targetId", "oldLabel", "newLabel"), "FAMILY_RENAMED": ("targetId", "oldLabel", "newLabel"), "NODE_METADATA_UPDATED": ("targetId", "oldValue", "newValue"),
    "EXTRACTION_CONFIDENCE_REVISED": ("targetId", "oldValue", "newValue"), "RELATIONSHIP_STRENGTH_REVISED": ("targetId", "oldValue", "newValue"), "SOURCE_CHANGED": ("sourceId", "oldContentHash", "newContentHash"),
    "CONTRADICTION_RESOLVED": ("contradictionId", "previousStatus", "newStatus"), "GAP_RESOLVED": ("gapId", "previousStatus", "newStatus"),
}


def touched() -> Column:
    """The ids that must not have been touched since by another run."""
    event = F.col("event_type")
    one = lambda name: F.array(payload(name))
    out = F.when(event == "ENTITY_MERGED", F.concat(one("survivorId"), texts("mergedIds"))).when(event == "ENTITY_SPLIT", F.concat(one("originalId"), texts("resultingIds")))
    out = out.when(event == "SOURCE_RETRACTED", one("sourceId")).when(event == "FAMILY_MERGED", F.concat(one("survivorFamilyId"), texts("mergedFamilyIds"))).when(event == "FAMILY_RELATION_REMOVED", F.array(payload("family_a"), payload("family_b")))
    for kind, (key, _, _) in EXCHANGED.items():
        out = out.when(event == kind, one(key))
    return F.coalesce(out, F.array().cast("array<string>"))


def interfered(events: DataFrame, log: DataFrame) -> DataFrame:
    """``events`` with ``blocked``: whether a later event of another run is about one of the ids that they touch.

    Each id keeps the last event of its two latest runs: one of them is another run."""
    runs = log.where("entity_id is not null").groupBy("entity_id", "run_id").agg(F.max("seq").alias("last"))
    w = Window.partitionBy("entity_id").orderBy(F.col("last").desc(), "run_id")
    two = runs.withColumn("_n", F.row_number().over(w)).where("_n <= 2").groupBy(F.col("entity_id").alias("_id")).agg(F.collect_list(F.struct(F.col("run_id").alias("run"), "last")).alias("_last"))
    ids = events.select("seq", "run_id", F.explode(touched()).alias("_id")).join(two, "_id")
    hit = ids.where(F.exists("_last", lambda x: (x["run"] != F.col("run_id")) & (x["last"] > F.col("seq")))).select("seq").distinct().withColumn("blocked", F.lit(True))
    return events.join(hit, "seq", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))


def _object(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def compensations(events: DataFrame, log: DataFrame) -> DataFrame:
    """``(seq, run_id, nth, event_type, entity_id, payload)``: the events that undo ``events`` of the class that needs it.

    Blocked events, and a retraction of a source that was never added, have none."""
    rows = interfered(events.where(rollback_class(F.col("event_type")) == "cross_run_mutation"), log).where("not blocked")
    kind = F.col("event_type")
    parts = []
    for name, (key, old, new) in EXCHANGED.items():
        extra = {"field": payload("field")} if old == "oldValue" else {}
        parts.append(rows.where(kind == name).select("seq", "run_id", F.lit(0).alias("nth"), "event_type", payload(key).alias("entity_id"), _object(**{key: payload(key)}, **extra, **{old: payload(new), new: payload(old)}).alias("payload")))
    snaps = F.expr("try_variant_get(parse_json(payload), '$.mergedSnapshots', 'array<struct<id string, label string, aliases array<string>>>')")
    restored = F.expr("try_variant_get(parse_json(payload), '$.restoredSnapshots', 'array<struct<id string, label string, aliases array<string>>>')")
    parts.append(rows.where(kind == "ENTITY_MERGED").select("seq", "run_id", F.lit(0), F.lit("ENTITY_SPLIT"), payload("survivorId"), _object(originalId=payload("survivorId"), resultingIds=texts("mergedIds"), restoredSnapshots=snaps)))
    parts.append(rows.where(kind == "ENTITY_SPLIT").select("seq", "run_id", F.lit(0), F.lit("ENTITY_MERGED"), payload("originalId"), _object(survivorId=payload("originalId"), mergedIds=texts("resultingIds"), mergedSnapshots=restored)))
    label = F.coalesce(F.try_element_at(F.filter(snaps, lambda s: s["id"] == F.col("_gone")), F.lit(1))["label"], F.col("_gone"))
    families = rows.where(kind == "FAMILY_MERGED").select("seq", "run_id", "payload", F.posexplode(texts("mergedFamilyIds")).alias("nth", "_gone"))
    parts.append(families.select("seq", "run_id", "nth", F.lit("FAMILY_CREATED"), "_gone", _object(family_id=F.col("_gone"), label=label)))
    parts.append(rows.where(kind == "FAMILY_RELATION_REMOVED").select("seq", "run_id", F.lit(0), F.lit("FAMILY_RELATED"), payload("family_a"), _object(relation_id=F.coalesce(payload("relation_id"), F.concat(F.lit("rollback-"), F.col("seq").cast("string"))), family_a=payload("family_a"), family_b=payload("family_b"), relation_type=payload("relation_type"))))
    added = of(log, "SOURCE_ADDED").select(payload("id").alias("_source"), "seq", "payload").groupBy("_source").agg(F.min_by("payload", "seq").alias("_added"))
    gone = rows.where(kind == "SOURCE_RETRACTED").withColumn("_source", payload("sourceId")).join(added, "_source")
    parts.append(gone.select("seq", "run_id", F.lit(0), F.lit("SOURCE_ADDED"), "_source", "_added"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def rollback_outcomes(log: DataFrame) -> DataFrame:
    """``(run_id, outcome, skipped, executed, blocked)`` if each run were rolled back now.

    A run that has been keeps ``already``; one with curation is refused; one with an event that cannot be undone stays whole."""
    cls = rollback_class(F.col("event_type"))
    counts = log.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(cls == "cross_run_mutation").alias("cross"), F.bool_or(F.col("event_type").isin(*CURATION)).alias("curated"), F.bool_or(F.col("event_type") == "RUN_ROLLED_BACK").alias("already"))
    undone = compensations(log, log).select("run_id", "seq").distinct().groupBy("run_id").agg(F.count("*").alias("undone"))
    out = counts.join(undone, "run_id", "left").withColumn("undone", F.coalesce("undone", F.lit(0)))
    blocked = F.col("cross") - F.col("undone")
    outcome = F.when(F.col("already"), F.lit("already")).when(F.col("curated"), F.lit("refused")).when(blocked > 0, F.lit("blocked")).otherwise(F.lit("executed"))
    done = outcome == "executed"
    return out.select("run_id", outcome.alias("outcome"), F.when(outcome.isin("executed", "blocked"), F.col("n") - F.col("cross")).otherwise(0).alias("skipped"), F.when(done, F.col("cross")).otherwise(0).alias("executed"), F.when(outcome == "blocked", blocked).otherwise(0).alias("blocked"))


def rollback_batch(log: DataFrame, run_id: str, at: str) -> DataFrame | None:
    """The events, in order, that take ``run_id`` back: a marker, then what undoes its effects; None if there is nothing to do.

    Raises if curation refuses it or an effect cannot be undone.  Append them in one batch, so that all or none appear."""
    row = rollback_outcomes(log).where(F.col("run_id") == F.lit(run_id)).first()
    if row is None or row["outcome"] == "already":
        return None
    if row["outcome"] != "executed":
        raise ValueError(f"run {run_id} cannot be rolled back: {row['outcome']}, {row['blocked']} blocked")
    marker = log.sparkSession.range(1).select(F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("nth"), F.lit("RUN_ROLLED_BACK").alias("event_type"), F.lit(None).cast("string").alias("entity_id"), F.to_json(F.struct(F.lit(run_id).alias("run_id"))).alias("payload"))
    undo = compensations(log.where(F.col("run_id") == F.lit(run_id)), log).select("seq", "nth", "event_type", "entity_id", "payload")
    return marker.union(undo).select(F.struct("seq", "nth").alias("ord"), F.lit(at).alias("timestamp"), "event_type", F.lit(run_id).alias("run_id"), F.when(F.col("seq") < 0, F.lit("system")).otherwise(F.lit("rollback")).alias("actor"), "entity_id", "payload")
