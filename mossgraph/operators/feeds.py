"""What happened, in words and in kinds of change; which runs hang; progress that is not told too often; graph reads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .projection import payload

# Events that are told by a fixed line.
LINES = {
    "SOURCE_CHANGED": "Source content changed", "CLAIM_MERGED": "Claim merged", "CLAIM_SPLIT": "Claim split", "CLAIM_RETRACTION_SET": "Claim retraction changed", "CLAIM_RELATION_CURATED": "Claim relation curated",
    "EVIDENCE_STANCE_OVERRIDDEN": "Evidence stance overridden",
}
# The kind of change that an event is.
BUCKETS = {
    "EVIDENCE_LINKED": "newEvidence", "CONTRADICTION_IDENTIFIED": "contradictionsOpened", "CONTRADICTION_RESOLVED": "contradictionsResolved", "GAP_OPENED": "gapsOpened", "GAP_RESOLVED": "gapsResolved", "SOURCE_CHANGED": "sourcesChanged",
    "CLAIM_MERGED": "curationEvents", "CLAIM_SPLIT": "curationEvents", "CLAIM_RETRACTION_SET": "curationEvents", "CLAIM_RELATION_CURATED": "curationEvents", "EVIDENCE_STANCE_OVERRIDDEN": "curationEvents",
}
# Where an event says its family, the first that is there, and the claims that it names.
OWN_FAMILY = ("familyId", "family_id", "observation.familyId")
NAMED_CLAIMS = ("claimId", "claimIdA", "claimIdB", "sourceClaimId", "survivorClaimId", "fromClaimId", "toClaimId", "reconciliation.canonicalClaimId", "relatedClaimId")
LEASE_SECONDS, LEASES = 15, 4
TERMINAL_EVENTS = ("RUN_COMPLETED", "RUN_FAILED", "RUN_CANCELLED", "RUN_INTERRUPTED", "RUN_ROLLED_BACK")


def told() -> Column:
    """An event in one line; an unknown one by its type."""
    event_type = F.col("event_type")
    unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    text = unknown(payload("observation.subjectText"))
    out = F.when(event_type == "CLAIM_OBSERVED", F.concat(F.when(payload("reconciliation.classification") == "new_claim", F.lit("New claim: ")).otherwise(F.lit("Updated claim: ")), text))
    out = out.when(event_type == "EVIDENCE_LINKED", F.concat(F.lit("Evidence linked to claim "), payload("claimId")))
    out = out.when(event_type == "CONTRADICTION_IDENTIFIED", F.concat(F.lit("Contradiction identified between claims "), payload("claimIdA"), F.lit(" and "), payload("claimIdB")))
    out = out.when(event_type == "CONTRADICTION_RESOLVED", F.concat(F.lit("Contradiction resolved: "), payload("contradictionId")))
    out = out.when(event_type == "GAP_OPENED", F.concat(F.lit("Gap opened: "), F.left(unknown(payload("question")), F.lit(80)))).when(event_type == "GAP_RESOLVED", F.concat(F.lit("Gap resolved: "), payload("gapId")))
    out = out.when(event_type == "SOURCE_OBSERVED", F.concat(F.lit("Source observed: "), unknown(F.coalesce(payload("title"), payload("domain")))))
    for kind, line in LINES.items():
        out = out.when(event_type == kind, F.lit(line))
    return out.otherwise(event_type)


def bucket() -> Column:
    """Which of twelve kinds of change an event is."""
    event_type = F.col("event_type")
    kind = payload("reconciliation.classification")
    out = F.when(event_type == "CLAIM_OBSERVED", F.when(kind == "supersedes", F.lit("supersededClaims")).when(kind == "new_claim", F.lit("newClaims")).otherwise(F.lit("updatedClaims")))
    for name, target in BUCKETS.items():
        out = out.when(event_type == name, F.lit(target))
    return out.otherwise(F.lit("otherEvents"))


def _named(events: DataFrame, word: str, fields: tuple[str, ...], out: str, first: bool = False) -> DataFrame:
    """``(seq, out)``: the values of fields of the payload, all of them without repeats or the first; each payload is parsed once.

    The names of the fields have ``word`` in them, so a payload without it has none of them, unless it spells a name with an escape."""
    some = events.where(F.col("payload").contains(word) | F.col("payload").contains("\\"))
    values = lambda v: [F.try_variant_get(v, f"$.{n}", "string") for n in fields]
    pick = (lambda v: F.array(F.coalesce(*values(v)))) if first else (lambda v: F.array_distinct(F.array(*values(v))))
    # As the one argument of a lambda, the parsed payload is not put in for each of its uses.
    return some.select("seq", F.explode(F.flatten(F.transform(F.array(F.parse_json("payload")), pick))).alias(out)).where(F.col(out).isNotNull())


def owning_families(events: DataFrame, claims: DataFrame) -> DataFrame:
    """``(seq, family_id)``: the families that an event is about, by its own field or through the claims that it names.

    ``claims(claim_id, family_id)``; an event of a merge or a relation belongs to the families of both claims, and to none
    through a claim without a family."""
    own = _named(events, "amily", OWN_FAMILY, "family_id", first=True)
    refs = _named(events, "laimId", NAMED_CLAIMS, "claim_id")
    return own.union(refs.join(claims, "claim_id").select("seq", "family_id").where("family_id is not null")).distinct()


def leases(log: DataFrame, now: Column) -> DataFrame:
    """``log(run_id, at, event_type)`` -> ``(run_id, verdict)`` of runs without an end: ``alive``, or, silent for LEASES intervals,
    ``cancel`` if a cancellation was asked for, ``resume`` if it has not started yet, ``interrupt`` otherwise."""
    runs = log.groupBy("run_id").agg(
        F.max("at").alias("_last"), F.bool_or(F.col("event_type").isin(*TERMINAL_EVENTS)).alias("_done"), F.bool_or(F.col("event_type") == "RUN_CANCELLATION_REQUESTED").alias("_asked"), F.bool_or(F.col("event_type") == "RUN_RUNNING").alias("_ran"),
    ).where("not _done")
    silent = now.cast("timestamp").cast("double") - F.col("_last").cast("timestamp").cast("double") > LEASES * LEASE_SECONDS
    return runs.select("run_id", F.when(~silent, F.lit("alive")).when(F.col("_asked"), F.lit("cancel")).when(~F.col("_ran"), F.lit("resume")).otherwise(F.lit("interrupt")).alias("verdict"))


def throttled(progress: DataFrame, interval: float) -> DataFrame:
    """``progress(run_id, seq, at, phase)``: what is told of each run: the first, a new phase, what comes ``interval`` seconds after
    the last that was told, and the last of all.

    What is told depends on what was told before, so each run is a fold over its rows, sorted within partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last, phase, held = None, None, None, None
        for batch in batches:
            out = []
            for run_id, seq, at, name in batch.itertuples(index=False):
                if run_id != current:
                    if held:
                        out.append(held)
                    current, last, phase, held = run_id, None, None, None
                if last is None or name != phase or at - last >= interval:
                    out.append((run_id, seq))
                    last, phase, held = at, name, None
                else:
                    held = (run_id, seq)
            yield pd.DataFrame(out, columns=["run_id", "seq"])
        if held:
            yield pd.DataFrame([held], columns=["run_id", "seq"])

    rows = progress.select("run_id", "seq", F.col("at").cast("double").alias("at"), "phase").repartition("run_id").sortWithinPartitions("run_id", "seq")
    return rows.mapInPandas(run, "run_id long, seq long")


def until_terminal(log: DataFrame, after: int) -> DataFrame:
    """Events of each run after a place, up to and with its first end: what a reader that follows the run gets."""
    ends = log.where(F.col("event_type").isin(*TERMINAL_EVENTS)).groupBy("run_id").agg(F.min("seq").alias("_end"))
    return log.join(ends, "run_id", "left").where((F.col("seq") > after) & (F.col("_end").isNull() | (F.col("seq") <= F.col("_end")))).drop("_end")


class Graph:
    """Named reads over the views: ``Graph(views).ask("claims", family_id="f1")``."""

    def __init__(self, views: dict[str, DataFrame]):
        self.views = views
        self.actions: dict[str, Callable[..., DataFrame]] = {name: self._rows(name) for name in views}

    def _rows(self, name: str) -> Callable[..., DataFrame]:
        def read(limit: int | None = None, **wanted) -> DataFrame:
            rows = self.views[name]
            for column, value in wanted.items():
                rows = rows.where(F.col(column) == F.lit(value)) if not isinstance(value, (list, tuple)) else rows.where(F.col(column).isin(*value))
            return rows if limit is None else rows.orderBy("id").limit(limit)

        return read

    def register(self, name: str, action: Callable[..., DataFrame]) -> None:
        self.actions[name] = action

    def ask(self, action: str, **arguments) -> DataFrame:
        if action not in self.actions:
            raise KeyError(f"no action {action!r}; there are {', '.join(sorted(self.actions))}")
        return self.actions[action](**arguments)
