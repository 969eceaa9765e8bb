"""Commands of curators: which of a stream of them happen, the events that they become, and what these do to the views.

A command carries the place of the log that its writer had seen.  It happens if that is where the log is when its turn comes, and
then moves the log on by one; the next to happen is the first later one that expects the next place and has not happened before.  What
has happened decides what can, so blocks of a bounded number of commands are decided one after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import saved
from .knowledge import aliases, last, of
from .projection import payload

# The event that a command of each kind becomes.
EVENTS = {"merge": "CLAIM_MERGED", "split": "CLAIM_SPLIT", "retract": "CLAIM_RETRACTION_SET", "relate": "CLAIM_RELATION_CURATED", "stance": "EVIDENCE_STANCE_OVERRIDDEN"}
CONTENT = ("actor", "kind", "body")


#: Commands that one task decides in order.
FOLD = 1_000_000


def happened(commands: DataFrame, cursor: int = 0) -> DataFrame:
    """``commands(seq, command_id, expected, ...)`` -> those that happen, as a loop over them would find.

    A command that has happened does not happen again, whatever place a repetition of it expects.  Blocks of about ``FOLD`` commands
    follow each other: from each go those that expect a place already taken and those that have happened in an earlier block,
    and one task decides what is left."""
    rows = saved(commands.select("seq", "command_id", "expected"))
    blocks = -(-rows.count() // FOLD)
    bounds = rows.stat.approxQuantile("seq", [k / blocks for k in range(1, blocks)], 0.1 / blocks) if blocks > 1 else []
    bounds = sorted({int(b) for b in bounds})
    parts: list[DataFrame] = []
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        block = rows.where(F.col("expected") >= cursor)
        block = block if low is None else block.where(F.col("seq") > low)
        block = block if high is None else block.where(F.col("seq") <= high)
        for part in parts:
            block = block.join(part.select("command_id"), "command_id", "left_anti")
        part = saved(block.select("seq", "command_id", "expected").repartition(1).sortWithinPartitions("seq").mapInArrow(_decided(cursor), rows.schema))
        parts.append(part)
        cursor += part.count()
    path = parts[0].select("seq")
    for part in parts[1:]:
        path = path.union(part.select("seq"))
    return commands.join(path, "seq", "left_semi")


def _decided(cursor: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The loop over commands in order, from the place ``cursor`` on."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, done = cursor, set()
        for batch in batches:
            kept = []
            for k, (name, expected) in enumerate(zip(batch.column("command_id").to_pylist(), batch.column("expected").to_pylist(), strict=True)):
                if expected == place and name not in done:
                    kept.append(k)
                    place += 1
                    if name is not None:
                        done.add(name)
            yield batch.take(pa.array(kept, pa.int64()))

    return fold


def command_outcomes(commands: DataFrame, cursor: int = 0) -> DataFrame:
    """``commands(seq, command_id, expected[, actor, kind, body])`` -> ``(seq, command_id, outcome, event_seq)``.

    ``applied``: it becomes the event at ``event_seq``; ``repeated``: it has happened, with the same content; ``conflict``: its id has,
    with another content; ``stale``: the log is not where it expects."""
    given = [c for c in CONTENT if c in commands.columns]
    rows = saved(commands.select("seq", "command_id", "expected", F.xxhash64(*given).alias("_content") if given else F.lit(0).alias("_content")))
    done = happened(rows, cursor).select("command_id", F.col("seq").alias("_at"), F.col("expected").alias("_place"), F.col("_content").alias("_was"))
    out = rows.join(done, "command_id", "left")
    outcome = F.when(F.col("_at") == F.col("seq"), F.lit("applied")).when(F.col("_at") < F.col("seq"), F.when(F.col("_was") == F.col("_content"), F.lit("repeated")).otherwise(F.lit("conflict"))).otherwise(F.lit("stale"))
    return out.select("seq", "command_id", outcome.alias("outcome"), F.when(F.col("_at") <= F.col("seq"), F.col("_place") + 1).alias("event_seq"))


def curation_events(commands: DataFrame, cursor: int = 0) -> DataFrame:
    """``(seq, run_id, event_type, payload)`` of the commands that happen; ``body`` is the payload."""
    kinds = F.create_map(*[F.lit(x) for pair in EVENTS.items() for x in pair])
    return happened(commands, cursor).select((F.col("expected") + 1).alias("seq"), F.concat(F.lit("curation:"), "command_id").alias("run_id"), kinds[F.col("kind")].alias("event_type"), F.col("body").alias("payload"))


def _results() -> Column:
    return F.expr("try_variant_get(parse_json(payload), '$.results', 'array<struct<claimId string, observationIds array<string>, evidenceIds array<string>, currentObservationId string>>')")


def _stays(merges: DataFrame) -> DataFrame:
    """``(id, claim, since)``: the claims that what was of ``id`` belongs to, one after another, by following merges."""
    reached = out = saved(merges.select("id", F.col("to").alias("claim"), F.col("at").alias("since")))
    while not reached.isEmpty():  # as many rounds as merges follow each other
        hop = merges.select(F.col("id").alias("claim"), F.col("to").alias("_to"), F.col("at").alias("_then"))
        reached = saved(reached.join(hop, "claim").where("_then > since").select("id", F.col("_to").alias("claim"), F.col("_then").alias("since")))
        out = out.union(reached)
    return out


def curated(views: dict[str, DataFrame], events: DataFrame) -> dict[str, DataFrame]:
    """``views`` after curation, as applying the events one by one would leave them.

    ``claims(id, family_id)``, ``observations(id, claim_id, observed_at)``, ``evidence(id, claim_id, stance)``, ``relations(id, from_id, to_id,
    relation)``; the result's claims have ``status``, ``merged_into``, the number of active observations, the current one (the latest
    active, of equals the smallest id) and the counts of supporting and opposing evidence, which a retracted claim has none of.
    Merges follow each other; a split gives observations and evidence to its results, which may be merged in their turn; to
    retract or restore a claim does the same to the observations that it has at that time."""
    merges = saved(of(events, "CLAIM_MERGED").select(payload("sourceClaimId").alias("id"), payload("survivorClaimId").alias("to"), F.col("seq").alias("at")))
    alias = saved(aliases(merges.select("id", "to")))
    results = saved(of(events, "CLAIM_SPLIT").select("seq", payload("sourceClaimId").alias("source"), F.explode(_results()).alias("r")))

    def owned(rows: DataFrame, field: str) -> DataFrame:
        """Which claim each row was given to, by its beginning or its last split, and the claim that it has come to since."""
        given = last(results.select("seq", F.explode(f"r.{field}").alias("id"), F.col("r.claimId").alias("_given")), "id", "_given").withColumnRenamed("seq", "_since")
        out = rows.join(given, "id", "left").withColumn("_first", F.coalesce("_given", "claim_id")).withColumn("_since", F.coalesce("_since", F.lit(-1)))
        now = alias.select(F.col("id").alias("_first"), F.col("to").alias("_now"))
        return out.join(now, "_first", "left").withColumn("claim_id", F.coalesce("_now", "_first")).drop("_given", "_now")

    observations = saved(owned(views["observations"].select("id", "claim_id", "observed_at"), "observationIds"))
    set_to = of(events, "CLAIM_RETRACTION_SET").select("seq", payload("target.kind").alias("kind"), payload("target.id").alias("target"), payload("newStatus").alias("status"))
    own = set_to.where("kind = 'observation'").select(F.col("target").alias("id"), "seq", "status")
    # an observation was of all the claims that it passed through, each from the merge into it to the merge out of it
    first = views["observations"].select("id", F.col("claim_id").alias("claim"), F.lit(-1).alias("since")).union(results.select(F.explode("r.observationIds"), F.col("r.claimId"), "seq"))
    passed = _stays(merges).withColumnRenamed("since", "_hop")
    through = first.union(first.join(passed.select(F.col("id").alias("claim"), F.col("claim").alias("_to"), "_hop"), "claim").where("_hop > since").select("id", "_to", "_hop"))
    stay = through.withColumn("until", F.lead("since").over(Window.partitionBy("id").orderBy("since")))
    shared = stay.join(set_to.where("kind = 'claim'"), F.col("claim") == F.col("target")).where("seq > since and (until is null or seq < until)").select("id", "seq", "status")
    status = last(own.union(shared), "id", "status").drop("seq")
    observations = saved(observations.join(status, "id", "left").select("id", "claim_id", "observed_at", F.coalesce("status", F.lit("active")).alias("status")))
    stance = last(of(events, "EVIDENCE_STANCE_OVERRIDDEN").select(payload("evidenceId").alias("id"), "seq", payload("newStance").alias("_stance")), "id", "_stance").drop("seq")
    evidence = saved(owned(views["evidence"].select("id", "claim_id", "stance"), "evidenceIds").join(stance, "id", "left").select("id", "claim_id", F.coalesce("_stance", "stance").alias("stance")))

    fresh = results.join(views["claims"].select(F.col("id").alias("source"), "family_id"), "source").select(F.col("r.claimId").alias("id"), "family_id")
    again = results.select(F.col("r.claimId").alias("_made"), F.col("source").alias("_of"))  # results of results have the family of the first
    lineage = aliases(again.select(F.col("_made").alias("id"), F.col("_of").alias("to")))
    deep = lineage.join(views["claims"].select(F.col("id").alias("to"), "family_id"), "to").select("id", "family_id")
    claims = views["claims"].select("id", "family_id").union(fresh.union(deep).distinct())
    gone = merges.select("id", F.col("at").alias("seq"), F.lit("merged").alias("status"), F.col("to").alias("merged_into")).union(results.select(F.col("source"), "seq", F.lit("split"), F.lit(None).cast("string")).distinct())
    state = last(gone.union(set_to.where("kind = 'claim'").select("target", "seq", "status", F.lit(None).cast("string"))), "id", "status", "merged_into").drop("seq")
    active = observations.where("status = 'active'").groupBy(F.col("claim_id").alias("id")).agg(F.count("*").alias("n_observations"), F.max("observed_at").alias("_at"))
    current = observations.where("status = 'active'").join(active.select(F.col("id").alias("claim_id"), "_at"), "claim_id").where("observed_at = _at").groupBy(F.col("claim_id").alias("id")).agg(F.min("id").alias("current_id"))
    counts = evidence.groupBy(F.col("claim_id").alias("id")).agg(F.count_if(F.col("stance") == "supports").alias("_s"), F.count_if(F.col("stance") == "opposes").alias("_o"))
    rows = claims.join(state, "id", "left").join(active.drop("_at"), "id", "left").join(current, "id", "left").join(counts, "id", "left")
    kept = lambda c: F.when(F.col("status").eqNullSafe("retracted"), 0).otherwise(F.coalesce(c, F.lit(0))).cast("long")
    rows = rows.select(
        "id", "family_id", F.coalesce("status", F.lit("active")).alias("status"), "merged_into", F.coalesce("n_observations", F.lit(0)).cast("long").alias("n_observations"), "current_id", kept("_s").alias("n_supports"), kept("_o").alias("n_opposes"),
    )
    told = of(events, "CLAIM_RELATION_CURATED").select(payload("relationId").alias("id"), "seq", payload("after.fromClaimId").alias("from_id"), payload("after.toClaimId").alias("to_id"), payload("after.relation").alias("relation"))
    versions = views["relations"].select("id", F.lit(-1).alias("seq"), "from_id", "to_id", "relation").unionByName(told)
    newest = last(versions, "id", "from_id", "to_id", "relation").where("relation is not null").drop("seq")
    end = lambda c: alias.select(F.col("id").alias(c), F.col("to").alias(f"_{c}"))
    relations = newest.join(end("from_id"), "from_id", "left").join(end("to_id"), "to_id", "left").select("id", F.coalesce("_from_id", "from_id").alias("from_id"), F.coalesce("_to_id", "to_id").alias("to_id"), "relation").where("from_id <> to_id")
    return {"claims": rows, "observations": observations, "evidence": evidence, "relations": relations}
