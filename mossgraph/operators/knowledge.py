"""Entities, families, threads, contradictions, gaps, sources and curation derived from the log, a set at a time.

Each view takes ``events(seq, run_id, event_type, entity_id, timestamp, payload)`` after rollback (``live_events``) and gives
what a fold in order of ``seq`` would end with: the first or last writer of each key, overlays, tombstones and aliases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import saved
from .projection import payload

# What a relation between families is when read from the other side.
INVERSE = {"adjacent": "adjacent", "contradicts": "contradicts", "parent": "child", "child": "parent"}


def of(events: DataFrame, *kinds: str) -> DataFrame:
    return events.where(F.col("event_type").isin(*kinds))


def texts(name: str) -> Column:
    """An array of strings in the payload; empty where there is none."""
    return F.coalesce(F.expr(f"try_variant_get(parse_json(payload), '$.{name}', 'array<string>')"), F.array().cast("array<string>"))


def last(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row a key: ``columns`` of its last row by ``seq``."""
    return rows.groupBy(key).agg(F.max_by(F.struct("seq", *columns), "seq").alias("_r")).select(key, F.col("_r.seq").alias("seq"), *[F.col(f"_r.{c}").alias(c) for c in columns])


def first(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min_by(F.struct("seq", *columns), "seq").alias("_r")).select(key, F.col("_r.seq").alias("seq"), *[F.col(f"_r.{c}").alias(c) for c in columns])


def overlaid(base: DataFrame, changes: DataFrame, key: str, *columns: str) -> DataFrame:
    """``base`` with ``columns`` of the last change of each key that comes after the row was written."""
    own = base.select(key, F.col("seq").alias("_at"))
    later = last(changes.join(own, key).where("seq > _at"), key, *columns).select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = base.join(later, key, "left")
    return out.withColumns({c: F.coalesce(f"_new_{c}", c) if c in base.columns else F.col(f"_new_{c}") for c in columns}).drop(*[f"_new_{c}" for c in columns])


def entities(events: DataFrame) -> DataFrame:
    """``(id, label, aliases, last_run)``: the last addition of each, relabelled; merged and split ones are gone.

    A relabelling or a merge counts only after the addition that stands, as that one writes the whole entity anew.  A merge
    gives the survivor the aliases of all whom it absorbed."""
    added = last(of(events, "NODE_ADDED").select(payload("id").alias("id"), "seq", payload("label").alias("label"), texts("aliases").alias("aliases"), F.col("run_id").alias("last_run")), "id", "label", "aliases", "last_run")
    named = overlaid(added, of(events, "NODE_RELABELED").select(payload("targetId").alias("id"), "seq", payload("newLabel").alias("label")), "id", "label")
    merges = of(events, "ENTITY_MERGED").select("seq", payload("survivorId").alias("id"), texts("mergedIds").alias("gone"), F.expr("try_variant_get(parse_json(payload), '$.mergedSnapshots', 'array<struct<id string, aliases array<string>>>')").alias("snaps"))
    won = merges.join(added.select("id", F.col("seq").alias("_at")), "id").where("seq > _at").select("id", F.explode_outer(F.flatten(F.transform("snaps", lambda s: F.coalesce(s["aliases"], F.array().cast("array<string>"))))).alias("alias"))
    wins = won.groupBy("id").agg(F.array_sort(F.collect_set("alias")).alias("more"))
    touched = of(events, "NODE_RELABELED", "NODE_METADATA_UPDATED", "ENTITY_MERGED").select(F.coalesce(payload("targetId"), payload("survivorId")).alias("id"), "seq", F.col("run_id").alias("last_run"))
    left = merges.select("seq", F.explode("gone").alias("id")).union(of(events, "ENTITY_SPLIT").select("seq", payload("originalId").alias("id"))).groupBy("id").agg(F.max("seq").alias("_gone"))
    out = overlaid(named, touched, "id", "last_run").join(wins, "id", "left").join(left, "id", "left").where("_gone is null or _gone < seq")
    aliases = F.array_sort(F.array_union("aliases", F.coalesce("more", F.array().cast("array<string>"))))
    return out.select("id", "label", aliases.alias("aliases"), "last_run")


def entity_fields(events: DataFrame) -> DataFrame:
    """``(id, field, value)``: the last value of each field of an entity that has been set after it was added."""
    added = of(events, "NODE_ADDED").select(payload("id").alias("id"), "seq").groupBy("id").agg(F.max("seq").alias("_at"))
    rows = of(events, "NODE_METADATA_UPDATED").select(payload("targetId").alias("id"), "seq", payload("field").alias("field"), payload("newValue").alias("value")).join(added, "id").where("seq > _at")
    return rows.groupBy("id", "field").agg(F.max_by("value", "seq").alias("value"))


def merge_history(events: DataFrame) -> DataFrame:
    """``(from_id, into_id, seq)``: where merged and split entities went, the last time."""
    merged = of(events, "ENTITY_MERGED").select("seq", F.explode(texts("mergedIds")).alias("from_id"), payload("survivorId").alias("into_id"))
    split = of(events, "ENTITY_SPLIT").select("seq", payload("originalId").alias("from_id"), F.coalesce(F.try_element_at(texts("resultingIds"), F.lit(1)), payload("originalId")).alias("into_id"))
    return last(merged.unionByName(split), "from_id", "into_id")


def accepted_claims(events: DataFrame) -> DataFrame:
    """Claims of the old kind, each with the one observation that is made up for it: ``(id, family_id, confidence, observation_id, observed_at)``."""
    rows = of(events, "CLAIM_ACCEPTED").select(payload("id").alias("id"), "seq", payload("familyId").alias("family_id"), payload("confidence", "double").alias("confidence"), F.concat(F.lit("obs_legacy_"), payload("id")).alias("observation_id"), F.col("timestamp").alias("observed_at"))
    return last(rows, "id", "family_id", "confidence", "observation_id", "observed_at").drop("seq")


def derived_relations(events: DataFrame) -> DataFrame:
    """Relations that an observation's class implies: ``(id, from_id, to_id, relation, strength)``."""
    rows = of(events, "CLAIM_OBSERVED").select("seq", payload("reconciliation.classification").alias("kind"), payload("reconciliation.canonicalClaimId").alias("from_id"), payload("reconciliation.matchedClaimId").alias("to_id"), payload("reconciliation.score", "double").alias("score"))
    names = F.when(F.col("kind") == "near_duplicate", F.lit("near_duplicate")).when(F.col("kind") == "elaboration", F.lit("elaborates")).when(F.col("kind") == "qualification", F.lit("qualifies")).when(F.col("kind") == "contradiction", F.lit("contradicts"))
    known = of(events, "CLAIM_OBSERVED").select(payload("reconciliation.canonicalClaimId").alias("to_id"), "seq").groupBy("to_id").agg(F.min("seq").alias("_since"))
    out = rows.withColumn("relation", names).where("relation is not null").join(known, "to_id").where("_since < seq")
    return out.select(F.concat(F.lit("rel_"), F.col("seq").cast("string")).alias("id"), "from_id", "to_id", "relation", F.when(F.col("score") >= 0.8, F.lit("strong")).otherwise(F.lit("weak")).alias("strength"))


def founders(events: DataFrame) -> DataFrame:
    """``(id, founder_seq, error)``: the first surviving observation of each claim; an error where it is one of an existing
    claim and no earlier observation of that claim was rolled back.  ``events`` here have a column ``rolled``."""
    rows = of(events, "CLAIM_OBSERVED").select(payload("reconciliation.canonicalClaimId").alias("id"), "seq", payload("reconciliation.classification").alias("kind"), "rolled")
    alive = first(rows.where("not rolled"), "id", "kind")
    lost = rows.where("rolled").groupBy("id").agg(F.min("seq").alias("_lost"))
    return alive.join(lost, "id", "left").select("id", F.col("seq").alias("founder_seq"), ((F.col("kind") == "same_claim") & ~F.coalesce(F.col("_lost") < F.col("seq"), F.lit(False))).alias("error"))


def contradictions(events: DataFrame) -> DataFrame:
    """``(id, family_id, claim_a, claim_b, status, resolved_run)``: the last identification, and what resolved it since."""
    rows = of(events, "CONTRADICTION_IDENTIFIED").select(payload("id").alias("id"), "seq", payload("familyId").alias("family_id"), payload("claimIdA").alias("claim_a"), payload("claimIdB").alias("claim_b"), F.coalesce(payload("resolutionStatus"), F.lit("unresolved")).alias("status"))
    base = last(rows, "id", "family_id", "claim_a", "claim_b", "status")
    return overlaid(base, of(events, "CONTRADICTION_RESOLVED").select(payload("contradictionId").alias("id"), "seq", payload("newStatus").alias("status"), F.col("run_id").alias("resolved_run")), "id", "status", "resolved_run").drop("seq")


def gaps(events: DataFrame) -> DataFrame:
    """``(id, family_id, priority, status, resolved_run)``."""
    rows = of(events, "GAP_OPENED").select(payload("id").alias("id"), "seq", payload("familyId").alias("family_id"), payload("priority", "int").alias("priority"), F.coalesce(payload("status"), F.lit("open")).alias("status"))
    base = last(rows, "id", "family_id", "priority", "status")
    return overlaid(base, of(events, "GAP_RESOLVED").select(payload("gapId").alias("id"), "seq", payload("newStatus").alias("status"), F.col("run_id").alias("resolved_run")), "id", "status", "resolved_run").drop("seq")


def added_sources(events: DataFrame) -> DataFrame:
    """Sources of the old kind with the fields that observations have since: ``(id, url, first_run, last_run, first_seen_at, last_seen_at, run_count)``."""
    run = F.coalesce(payload("firstSeenRunId"), payload("runId"), F.col("run_id"))
    at = F.coalesce(payload("retrievedAt"), F.col("timestamp"))
    rows = of(events, "SOURCE_ADDED").select(
        payload("id").alias("id"), "seq", F.coalesce(payload("canonicalUrl"), payload("url")).alias("url"), run.alias("first_run"), F.coalesce(payload("lastSeenRunId"), run).alias("last_run"), at.alias("first_seen_at"),
        F.coalesce(payload("lastSeenAt"), at).alias("last_seen_at"), F.coalesce(payload("runCount", "int"), F.lit(1)).alias("run_count"),
    )
    return last(rows, "id", "url", "first_run", "last_run", "first_seen_at", "last_seen_at", "run_count").drop("seq")


def families(events: DataFrame) -> DataFrame:
    """``(id, label, created_at, last_activity)``: the first creation holds; renamed, touched and merged since."""
    made = first(of(events, "FAMILY_CREATED").select(payload("family_id").alias("id"), "seq", payload("label").alias("label"), F.coalesce(payload("createdAt"), F.col("timestamp")).alias("created_at"), F.col("timestamp").alias("last_activity")), "id", "label", "created_at", "last_activity")
    named = overlaid(made, of(events, "FAMILY_RENAMED").select(payload("targetId").alias("id"), "seq", payload("newLabel").alias("label")), "id", "label")
    moves = of(events, "FAMILY_RENAMED", "FAMILY_RESOLVED", "FAMILY_MERGED").select(F.coalesce(payload("targetId"), payload("familyId"), payload("survivorFamilyId")).alias("id"), "seq", F.col("timestamp").alias("last_activity"))
    gone = of(events, "FAMILY_MERGED").select(F.explode(texts("mergedFamilyIds")).alias("id"), "seq").groupBy("id").agg(F.max("seq").alias("_gone"))
    return overlaid(named, moves, "id", "last_activity").join(gone, "id", "left").where("_gone is null or _gone < seq").select("id", "label", "created_at", "last_activity")


def memberships(events: DataFrame) -> DataFrame:
    """``(entity_id, family_id, confidence)``: the first of each pair, from creations and classifications."""
    made = of(events, "FAMILY_CREATED").select("seq", payload("family_id").alias("family_id"), F.explode(texts("entityIds")).alias("entity_id"), F.lit(None).cast("double").alias("confidence"))
    told = of(events, "FAMILY_CLASSIFIED").select("seq", payload("family_id").alias("family_id"), payload("entity_id").alias("entity_id"), payload("confidence", "double").alias("confidence"))
    rows = made.unionByName(told)
    return rows.groupBy("entity_id", "family_id").agg(F.min_by(F.struct("confidence"), "seq").alias("_r")).select("entity_id", "family_id", F.col("_r.confidence").alias("confidence"))


def family_relations(events: DataFrame) -> DataFrame:
    """``(family_id, other_id, relation)`` from both sides; a removal takes away all relations of a pair that came before."""
    told = of(events, "FAMILY_RELATED").select("seq", payload("family_a").alias("a"), payload("family_b").alias("b"), payload("relation_type").alias("r"))
    inverse = F.create_map(*[F.lit(x) for pair in INVERSE.items() for x in pair])
    both = told.select("seq", F.col("a").alias("family_id"), F.col("b").alias("other_id"), F.col("r").alias("relation")).union(told.select("seq", "b", "a", F.try_element_at(inverse, F.col("r"))).where("r is not null"))
    both = both.where("relation is not null")
    cut = of(events, "FAMILY_RELATION_REMOVED").select(payload("family_a").alias("a"), payload("family_b").alias("b"), "seq")
    cuts = cut.select(F.col("a").alias("family_id"), F.col("b").alias("other_id"), "seq").union(cut.select("b", "a", "seq")).groupBy("family_id", "other_id").agg(F.max("seq").alias("_cut"))
    return both.join(cuts, ["family_id", "other_id"], "left").where("_cut is null or _cut < seq").select("family_id", "other_id", "relation").distinct()


def aliases(moves: DataFrame) -> DataFrame:
    """``moves(id, to)`` -> ``(id, to)`` with chains followed; an id of a cycle ends at the smallest of the cycle.

    Pointers double in length each round and stop after as many rounds as the length of the longest chain has bits."""
    start = saved(moves.where("id <> to").groupBy("id").agg(F.min("to").alias("to")))
    alias, rounds = start, max(1, start.count().bit_length() + 1)
    for _ in range(rounds):
        far = alias.select(F.col("id").alias("_mid"), F.col("to").alias("_far"))
        step = saved(alias.join(far, F.col("to") == F.col("_mid"), "left").select("id", F.coalesce("_far", "to").alias("to"), F.col("_far").isNotNull().alias("_moved")))
        alias = step.drop("_moved")
        if step.where("_moved").isEmpty():
            return alias
    # What still moves leads into a cycle: all of whose members point at one another.
    ends = alias.join(start.select(F.col("id").alias("_mid")), F.col("to") == F.col("_mid"), "left")
    stuck = saved(ends.select("id", "to", F.col("_mid").isNotNull().alias("_stuck")))
    from .graph import components

    rings = components(stuck.where("_stuck").join(start.withColumnRenamed("to", "_next"), "id").select(F.col("id").alias("a"), F.col("_next").alias("b")))
    return stuck.join(rings, "id", "left").select("id", F.when(F.col("_stuck"), F.col("component")).otherwise(F.col("to")).alias("to")).where("id <> to")


def threads(events: DataFrame) -> DataFrame:
    """``(id, family_id, label, status)``: the first creation holds; families merged since are followed."""
    made = first(of(events, "THREAD_CREATED").select(payload("threadId").alias("id"), "seq", payload("familyId").alias("family"), payload("label").alias("label")), "id", "family", "label")
    moves = aliases(of(events, "FAMILY_MERGED").select(F.explode(texts("mergedFamilyIds")).alias("id"), payload("survivorFamilyId").alias("to")))
    done = of(events, "THREAD_RESOLVED").select(payload("threadId").alias("id"), "seq").groupBy("id").agg(F.max("seq").alias("_done"))
    out = made.join(moves.withColumnRenamed("id", "family"), "family", "left").join(done, "id", "left")
    return out.select("id", F.coalesce("to", "family").alias("family_id"), "label", F.when(F.col("_done") > F.col("seq"), F.lit("resolved")).otherwise(F.lit("open")).alias("status"))


def retractions(events: DataFrame) -> DataFrame:
    """``(kind, id, status)``: the last status that curation gave to a claim or an observation."""
    rows = of(events, "CLAIM_RETRACTION_SET").select("seq", payload("target.kind").alias("kind"), payload("target.id").alias("id"), payload("newStatus").alias("status"))
    return rows.groupBy("kind", "id").agg(F.max_by("status", "seq").alias("status"))


def curated_relations(events: DataFrame) -> DataFrame:
    """``(id, relation, stale)``: relations after curation; ``stale`` counts curations whose picture of the relation was not
    what the one before had left."""
    rows = of(events, "EDGE_ADDED", "CLAIM_RELATION_CURATED").select(
        "seq", F.coalesce(payload("relationId"), payload("id")).alias("id"), F.when(F.col("event_type") == "CLAIM_RELATION_CURATED", payload("before.relation")).alias("before"),
        F.when(F.col("event_type") == "CLAIM_RELATION_CURATED", payload("after.relation")).otherwise(payload("relation")).alias("after"), (F.col("event_type") == "CLAIM_RELATION_CURATED").alias("curated"),
    )
    w = Window.partitionBy("id").orderBy("seq")
    marked = rows.withColumn("_stale", F.col("curated") & ~F.col("before").eqNullSafe(F.lag("after").over(w)))
    return marked.groupBy("id").agg(F.max_by("after", "seq").alias("relation"), F.count_if("_stale").alias("stale"))


def stances(events: DataFrame) -> DataFrame:
    """``(id, claim_id, stance)`` of evidence, with the stance that curation gave it since."""
    rows = of(events, "EVIDENCE_LINKED").select(payload("id").alias("id"), "seq", payload("claimId").alias("claim_id"), payload("stance").alias("stance"))
    base = last(rows, "id", "claim_id", "stance")
    return overlaid(base, of(events, "EVIDENCE_STANCE_OVERRIDDEN").select(payload("evidenceId").alias("id"), "seq", payload("newStance").alias("stance")), "id", "stance").drop("seq")


def split_claims(events: DataFrame) -> DataFrame:
    """``(source_id, id, n_observations, n_evidence, error)`` of each result of a split.

    It is an error if an observation or a piece of evidence is in two results, or if a result's id is used twice."""
    results = F.expr("try_variant_get(parse_json(payload), '$.results', 'array<struct<claimId string, observationIds array<string>, evidenceIds array<string>>>')")
    rows = of(events, "CLAIM_SPLIT").select(payload("sourceClaimId").alias("source_id"), results.alias("r"))
    flat = lambda f: F.flatten(F.transform("r", lambda x: x[f]))
    twice = lambda a: F.size(F.array_distinct(a)) != F.size(a)
    bad = twice(flat("observationIds")) | twice(flat("evidenceIds")) | twice(F.transform("r", lambda x: x["claimId"]))
    return rows.select("source_id", bad.alias("error"), F.explode("r").alias("x")).select("source_id", F.col("x.claimId").alias("id"), F.size("x.observationIds").alias("n_observations"), F.size("x.evidenceIds").alias("n_evidence"), "error")


def recomputed_claims(observations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Counts and the current observation of each claim from active rows.

    ``observations(claim_id, id, observed_at, status, legacy)``: made-up ones count only where there are no others.
    ``evidence(claim_id, stance, active)``."""
    real = Window.partitionBy("claim_id")
    rows = observations.withColumn("_real", F.max(~F.col("legacy")).over(real)).where("(not legacy or not _real) and coalesce(status, 'active') = 'active'")
    current = rows.groupBy("claim_id").agg(F.count("*").alias("n_observations"), F.max("observed_at").alias("_at"))
    latest = rows.join(current.select("claim_id", F.col("_at")), "claim_id").where("observed_at = _at").groupBy("claim_id").agg(F.min("id").alias("current_id"))
    counts = evidence.where("active").groupBy("claim_id").agg(F.count_if(F.col("stance") == "supports").alias("n_supports"), F.count_if(F.col("stance") == "opposes").alias("n_opposes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return current.select("claim_id", "n_observations").join(latest, "claim_id").join(counts, "claim_id", "left").select("claim_id", "n_observations", "current_id", zero("n_supports"), zero("n_opposes"))


def confidence_history(observations: DataFrame) -> DataFrame:
    """``(claim_id, points)``: each claim's confidences in order of time, then id."""
    return observations.groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("observed_at", "id", "confidence"))), lambda p: p["confidence"]).alias("points"))


#: The views that a rebuild makes, by name; a caller may pass others, or more.
REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {
    "entities": entities, "families": families, "memberships": memberships, "family_relations": family_relations, "threads": threads, "claims": accepted_claims, "evidence": stances, "contradictions": contradictions, "gaps": gaps, "sources": added_sources,
}


def rebuild(events: DataFrame, registry: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> dict[str, DataFrame]:
    """Every view of the registry from the events that count."""
    return {name: view(events) for name, view in (registry or REGISTRY).items()}
