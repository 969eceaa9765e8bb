"""What may stand in the log: versions of payloads, references between events, and views that hold together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .knowledge import of, texts
from .projection import payload


@dataclass
class Codec:
    """Versions of one event type: required fields with their VARIANT types, and how to lift a payload to the next version."""

    versions: dict[int, dict[str, str]]
    upcasts: dict[int, Callable[[Column], Column]] = field(default_factory=dict)

    @property
    def latest(self) -> int:
        return max(self.versions)


def with_field(body: Column, name: str, value: str) -> Column:
    """A JSON object with one more field, given as JSON."""
    return F.regexp_replace(body, r"\s*\}\s*$", f',"{name}":{value}}}')


def example_codecs() -> dict[str, Codec]:
    """Codecs of a relabelling whose second version has a weight."""
    first = {"targetId": "STRING", "oldLabel": "STRING", "newLabel": "STRING"}
    return {"NODE_RELABELED": Codec({1: first, 2: first | {"weight": "BIGINT"}}, {1: lambda body: with_field(body, "weight", "1")})}


def _fits(body: Column, fields: dict[str, str]) -> Column:
    value = F.try_parse_json(body)
    out = value.isNotNull()
    for name, kind in fields.items():
        out = out & F.coalesce(F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant")) == kind, F.lit(False))
    return out


def decoded(rows: DataFrame, codecs: dict[str, Codec]) -> DataFrame:
    """``rows(event_type, version, payload)`` with ``error``, and ``payload`` lifted to the latest version where there is none.

    Unknown type, unsupported version, invalid payload, in this order; a payload is checked again after each step up."""
    known = F.col("event_type").isin(*codecs)
    error = F.when(~known, F.lit("EVENT_TYPE_UNKNOWN"))
    supported, body = F.lit(False), F.col("payload")
    bad, lifted = F.lit(False), F.col("payload")
    for name, codec in codecs.items():
        for version in codec.versions:
            mine = (F.col("event_type") == name) & (F.col("version") == version)
            supported = supported | mine
            wrong, body = ~_fits(F.col("payload"), codec.versions[version]), F.col("payload")
            for step in range(version, codec.latest):
                body = codec.upcasts[step](body) if step in codec.upcasts else body
                wrong = wrong | ~_fits(body, codec.versions[step + 1])
            bad, lifted = F.when(mine, wrong).otherwise(bad), F.when(mine, body).otherwise(lifted)
    error = error.when(~supported, F.lit("EVENT_VERSION_UNSUPPORTED")).when(bad, F.lit("EVENT_PAYLOAD_INVALID"))
    return rows.withColumns({"error": error, "payload": lifted})


# Which events bring a thing into being, and which refer to it: (kind, event types, field, whether a list).
DEFINED = (
    ("family", ("FAMILY_CREATED",), "family_id"), ("entity", ("NODE_ADDED",), "id"), ("contradiction", ("CONTRADICTION_IDENTIFIED",), "id"), ("gap", ("GAP_OPENED",), "id"), ("thread", ("THREAD_CREATED",), "threadId"),
    ("evidence", ("EVIDENCE_LINKED",), "id"), ("claim", ("CLAIM_ACCEPTED",), "id"), ("claim", ("CLAIM_OBSERVED",), "reconciliation.canonicalClaimId"), ("source", ("SOURCE_ADDED",), "id"), ("source", ("SOURCE_OBSERVED",), "sourceId"),
    ("observation", ("CLAIM_OBSERVED",), "observation.id"), ("edge", ("EDGE_ADDED",), "id"),
)
REFERRED = (
    ("family", ("FAMILY_RENAMED",), "targetId", False), ("family", ("FAMILY_CLASSIFIED",), "family_id", False), ("family", ("FAMILY_RELATED", "FAMILY_RELATION_REMOVED"), "family_a", False),
    ("family", ("FAMILY_RELATED", "FAMILY_RELATION_REMOVED"), "family_b", False), ("family", ("FAMILY_MERGED",), "survivorFamilyId", False), ("family", ("FAMILY_MERGED",), "mergedFamilyIds", True),
    ("family", ("THREAD_CREATED", "CLAIM_ACCEPTED", "CONTRADICTION_IDENTIFIED", "GAP_OPENED", "RUN_STARTED", "RUN_QUEUED"), "familyId", False), ("family", ("CLAIM_OBSERVED",), "observation.familyId", False),
    ("entity", ("NODE_RELABELED", "NODE_METADATA_UPDATED", "EXTRACTION_CONFIDENCE_REVISED", "RELATIONSHIP_STRENGTH_REVISED"), "targetId", False), ("entity", ("FAMILY_CLASSIFIED",), "entity_id", False),
    ("entity", ("ENTITY_MERGED",), "survivorId", False), ("entity", ("ENTITY_MERGED",), "mergedIds", True), ("entity", ("ENTITY_SPLIT",), "originalId", False), ("entity", ("CLAIM_ACCEPTED",), "subjectEntityId", False),
    ("entity", ("CLAIM_OBSERVED",), "observation.subjectEntityId", False), ("contradiction", ("CONTRADICTION_RESOLVED",), "contradictionId", False), ("gap", ("GAP_RESOLVED",), "gapId", False),
    ("thread", ("THREAD_RESOLVED", "CLAIM_ACCEPTED", "GAP_OPENED", "RUN_STARTED", "RUN_QUEUED"), "threadId", False), ("evidence", ("EVIDENCE_STANCE_OVERRIDDEN",), "evidenceId", False),
    ("claim", ("EVIDENCE_LINKED", "CLAIM_EXPIRED", "EVIDENCE_STANCE_OVERRIDDEN"), "claimId", False), ("claim", ("EDGE_ADDED",), "fromClaimId", False), ("claim", ("EDGE_ADDED",), "toClaimId", False),
    ("claim", ("CONTRADICTION_IDENTIFIED",), "claimIdA", False), ("claim", ("CONTRADICTION_IDENTIFIED",), "claimIdB", False), ("claim", ("CLAIM_OBSERVED",), "reconciliation.matchedClaimId", False),
    ("claim", ("CLAIM_MERGED", "CLAIM_SPLIT"), "sourceClaimId", False), ("claim", ("CLAIM_MERGED",), "survivorClaimId", False), ("claim", ("GAP_OPENED",), "relatedClaimId", False),
    ("source", ("EVIDENCE_LINKED", "SOURCE_CHANGED", "SOURCE_RETRACTED", "SOURCE_READ"), "sourceId", False), ("edge", ("EDGE_REMOVED",), "edgeId", False),
)


def dangling(events: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """``(seq, event_type, kind, ref)``: references to what no earlier event brought into being.

    One pass lists the references of every event; the things are aggregated to their first event before the join."""
    wanted = [r for r in REFERRED if kinds is None or r[0] in kinds]
    none = F.array().cast("array<struct<kind:string,ref:string>>")

    def listed(kind: str, types: tuple[str, ...], name: str, many: bool) -> Column:
        found = F.transform(texts(name) if many else F.array(payload(name)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("ref")))
        return F.when(F.col("event_type").isin(*types), found).otherwise(none)

    lists = [listed(*one) for one in wanted]
    refs = events.select("seq", "event_type", F.explode(F.array_distinct(F.concat(*lists))).alias("r")).select("seq", "event_type", "r.kind", "r.ref").where("ref is not null")
    known = None
    for kind, types, name in DEFINED:
        if kinds is None or kind in kinds:
            rows = of(events, *types).select(F.lit(kind).alias("kind"), payload(name).alias("ref"), "seq")
            known = rows if known is None else known.union(rows)
    since = known.groupBy("kind", "ref").agg(F.min("seq").alias("_since"))
    return refs.join(since, ["kind", "ref"], "left").where("_since is null or _since >= seq").select("seq", "event_type", "kind", "ref").distinct()


def projection_problems(views: dict[str, DataFrame]) -> DataFrame:
    """``(problem, id)``: rows of the views whose references do not hold.

    Views: families(id), threads(id, family_id), claims(id, family_id, thread_id), evidence(id, claim_id),
    relations(id, from_id, to_id)."""
    named = lambda rows, problem: rows.select(F.lit(problem).alias("problem"), F.col("id").cast("string").alias("id"))
    families, claims = views["families"].select(F.col("id").alias("family_id")), views["claims"].select(F.col("id").alias("claim_id"))
    held = views["threads"].select(F.col("id").alias("thread_id"), F.col("family_id").alias("_family"))
    threaded = views["claims"].where("thread_id is not null").join(held, "thread_id", "left").where("not (_family <=> family_id)")
    loose = views["relations"].select("id", F.explode(F.array("from_id", "to_id")).alias("claim_id")).join(claims, "claim_id", "left_anti").dropDuplicates(["id"])
    parts = [
        named(views["claims"].join(families, "family_id", "left_anti"), "claim family"), named(threaded, "claim thread"), named(views["evidence"].join(claims, "claim_id", "left_anti"), "evidence claim"),
        named(loose, "relation"), named(views["threads"].join(families, "family_id", "left_anti"), "thread family"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def verified(log: DataFrame, codecs: dict[str, Codec], stored: DataFrame, derived: DataFrame, key: str = "id", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """``(check, severity, n)``: hashes, codecs, references (of ``kinds``) and parity of a stored view with the one derived from the log."""
    from .evaluate import table_diff

    hashes = log.where(F.sha2(F.col("payload").cast("binary"), 256) != F.col("payload_hash"))
    broken = decoded(log.where(F.col("event_type").isin(*codecs)).withColumnRenamed("event_version", "version"), codecs).where("error is not null")
    counted = lambda rows, name: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), F.when(F.col("n") > 0, F.lit("error")).otherwise(F.lit("ok")).alias("severity"), "n")
    return counted(hashes, "payload hashes").union(counted(broken, "payload codecs")).union(counted(dangling(log, kinds), "references")).union(counted(table_diff(stored, derived, key), "read model"))


def doctor(log: DataFrame, cursor: int | None, status: str = "ready") -> DataFrame:
    """``(name, status, detail)``: whether the log has events, whether places repeat, whether payloads are what their hashes say, and
    how far a read model at ``cursor`` is behind; ``overall`` is the worst.

    ``log(seq, payload[, payload_hash])``, read once for all checks; ``status`` of a read model is ready, rebuilding or dirty."""
    changed = F.sha2(F.col("payload").cast("binary"), 256) != F.col("payload_hash") if "payload_hash" in log.columns else F.lit(False)
    found = log.groupBy("seq").agg(F.count("*").alias("n"), F.count_if(changed).alias("bad")).agg(F.max("seq").alias("last"), F.count_if(F.col("n") > 1).alias("twice"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    at = F.lit(cursor).cast("long")
    lag = F.when(F.col("last").isNull(), 0).otherwise(F.greatest(F.lit(0), F.col("last") - F.coalesce(at, F.lit(0))))
    said = F.when(lag > 0, F.concat(F.lit(" (lag "), lag.cast("string"), F.lit(")"))).otherwise(F.lit(""))
    check = lambda name, state, detail: F.struct(F.lit(name).alias("name"), state.alias("status"), detail.alias("detail"))
    either = lambda bad: F.when(bad, F.lit("error")).otherwise(F.lit("ok"))
    checks = F.array(
        check("event_log", F.when(F.col("last").isNull(), F.lit("warning")).otherwise(F.lit("ok")), F.when(F.col("last").isNull(), F.lit("no events recorded yet")).otherwise(F.concat(F.lit("latest seq "), F.col("last").cast("string")))),
        check("places", either(F.col("twice") > 0), F.concat(F.col("twice").cast("string"), F.lit(" repeated"))), check("payloads", either(F.col("bad") > 0), F.concat(F.col("bad").cast("string"), F.lit(" changed"))),
        check("read_model", F.when((F.lit(status) == "ready") & (lag == 0), F.lit("ok")).when(F.lit(status) == "dirty", F.lit("error")).otherwise(F.lit("warning")), F.concat(F.lit(f"{status} at seq "), F.coalesce(at, F.lit(0)).cast("string"), said)),
    )
    states = F.transform(F.col("checks"), lambda c: c["status"])
    overall = F.when(F.array_contains(states, "error"), F.lit("error")).when(F.array_contains(states, "warning"), F.lit("warning")).otherwise(F.lit("ok"))
    return found.select(checks.alias("checks")).select(F.explode(F.concat("checks", F.array(F.struct(F.lit("overall").alias("name"), overall.alias("status"), F.lit("").alias("detail"))))).alias("c")).select("c.*")


def worst(checks: DataFrame) -> DataFrame:
    """The worst severity of all checks: error before warning before ok; ``ok`` where there are none."""
    rank = F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    return checks.agg(F.coalesce(F.max(rank), F.lit(0)).alias("r"), F.count("*").alias("checks")).select(F.element_at(F.array(F.lit("ok"), F.lit("warning"), F.lit("error")), F.col("r") + 1).alias("severity"), "checks")
