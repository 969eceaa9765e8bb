"""What is believed and why, what happened, what changed, and what to look into next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.addresses import authority_rank


def belief_view(claims: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Each claim with its evidence by stance and the strongest supporting and opposing source.

    Evidence is summed per claim before claims are joined, so each table is shuffled once by the claim."""
    cited = evidence.join(sources.select(F.col("id").alias("source_id"), "title", "domain", "authority_class"), "source_id", "left").withColumn("rank", authority_rank(F.col("authority_class")))
    best = lambda stance: F.min(F.when(F.col("stance") == stance, F.struct("rank", "seq_in_claim", F.col("id").alias("evidence_id"), "source_id", "authority_class")))
    summed = cited.groupBy("claim_id").agg(
        *[F.count_if(F.col("stance") == s).alias(f"n_{s}") for s in ("supports", "opposes", "context")],
        F.countDistinct("domain").alias("n_domains"), best("supports").alias("s"), best("opposes").alias("o"),
    )
    joined = claims.join(summed, claims["id"] == summed["claim_id"], "left")
    return joined.select(
        claims["id"].alias("claim_id"), "family_id", "epistemic_status", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_supports", "n_opposes", "n_context", "n_domains")],
        F.col("s.source_id").alias("strongest_support"), F.col("s.authority_class").alias("support_class"), F.col("o.source_id").alias("strongest_oppose"),
    )


def provenance(claims: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Claim, evidence, source: one row a link, claims without evidence kept."""
    e = evidence.select(F.col("id").alias("evidence_id"), "claim_id", "source_id", "stance")
    s = sources.select(F.col("id").alias("source_id"), "domain", "authority_class")
    return claims.select(F.col("id").alias("claim_id")).join(e, "claim_id", "left").join(s, "source_id", "left")


def provenance_chains(observations: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """``(claim_id, observation_id, evidence_id, source_id, stance, domain, part)`` of each claim.

    ``observations(id, claim_id)``, each with its evidence, ``attributed``, or alone, ``bare``; evidence of no observation is
    ``unattributed`` and that of one that is not the claim's an ``orphan``.  ``evidence(id, claim_id, observation_id, source_id, stance)``."""
    own = observations.select("claim_id", F.col("id").alias("observation_id"), F.lit(True).alias("_own"))
    e = evidence.select("claim_id", "observation_id", F.col("id").alias("evidence_id"), "source_id", "stance")
    both = own.join(e, ["claim_id", "observation_id"], "full")
    part = F.when(F.col("evidence_id").isNull(), F.lit("bare")).when(F.col("_own"), F.lit("attributed")).when(F.col("observation_id").isNull(), F.lit("unattributed")).otherwise(F.lit("orphan"))
    s = sources.select(F.col("id").alias("source_id"), "domain")
    return both.withColumn("part", part).join(s, "source_id", "left").select("claim_id", "observation_id", "evidence_id", "source_id", "stance", "domain", "part")


def described(event_type: Column, value: Column) -> Column:
    return (
        F.when(event_type == "RUN_QUEUED", F.lit("Run queued"))
        .when(event_type == "RUN_RUNNING", F.lit("Run is running"))
        .when(event_type == "RUN_COMPLETED", F.concat(F.lit("Run completed with "), F.floor(value).cast("long").cast("string")))
        .when(event_type == "RUN_FAILED", F.lit("Run failed"))
        .otherwise(event_type)
    )


def timeline(direct: DataFrame, linked: DataFrame, limit: int | None = None) -> DataFrame:
    """Events of two paths as one list without repeats, oldest first."""
    both = direct.unionByName(linked).dropDuplicates(["seq"])
    return both.orderBy("seq").limit(limit) if limit else both


def change_feed(log: DataFrame, since: int, limit: int, wanted: list[str], family: int | None = None) -> DataFrame:
    """Events after ``since`` by kind of change; the raw limit comes before the filter of types, as paging needs it."""
    rows = log.where(F.col("seq") > since)
    if family is not None:
        rows = rows.where(F.col("family_id") == family)
    raw = rows.orderBy("seq").limit(max(5 * limit, 200) if family is not None else limit)
    return raw.where(F.col("event_type").isin(*wanted)).orderBy("seq").limit(limit)


def research_targets(gaps: DataFrame, contradictions: DataFrame) -> DataFrame:
    """Open questions and unresolved contradictions in the order of urgency: score, type, id."""
    g = gaps.where(F.col("status").isin("open", "partially_resolved") & (F.trim("question") != "")).select(
        F.lit("gap").alias("type"), F.col("id").cast("string").alias("id"), (F.col("priority") - F.when(F.col("single_source"), F.lit(0.5)).otherwise(F.lit(0.0))).alias("score")
    )
    c = contradictions.where("resolution_status = 'unresolved'").select(F.lit("contradiction").alias("type"), F.col("id").cast("string").alias("id"), F.lit(2.0).alias("score"))
    return g.unionByName(c).withColumn("place", F.row_number().over(Window.partitionBy("type").orderBy("score", "id")).cast("long"))


def source_history(observations: DataFrame) -> DataFrame:
    """Observations of a source, each marked if a change was recorded between the one before and it."""
    w = Window.partitionBy("source").orderBy("seq")
    lined = observations.withColumn("changed", F.coalesce(F.lag("event_type").over(w) == "SOURCE_CHANGED", F.lit(False)))
    return lined.where("event_type <> 'SOURCE_CHANGED'")


def family_dashboard(families: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """For each family its claims by status, distinct sources and a line of narrative."""
    per_claim = evidence.groupBy("claim_id").agg(F.collect_set("source_id").alias("sources"))
    c = claims.join(per_claim, claims["id"] == per_claim["claim_id"], "left")
    by = c.groupBy("family_id").agg(
        F.count("*").alias("n_claims"), F.count_if(F.col("expired_at").isNull()).alias("n_active"),
        F.count_if(F.col("epistemic_status") == "contested").alias("n_contested"), F.max("last_seen_at").alias("last_activity"),
    )
    sources = c.select("family_id", F.explode("sources").alias("s")).groupBy("family_id").agg(F.countDistinct("s").alias("n_sources"))
    out = families.select(F.col("id").alias("family_id"), "label").join(by, "family_id", "left").join(sources, "family_id", "left")
    out = out.select("family_id", "label", *[F.coalesce(c_, F.lit(0)).cast("long").alias(c_) for c_ in ("n_claims", "n_active", "n_contested", "n_sources")], "last_activity")
    return out.withColumn("narrative", F.concat(F.col("label"), F.lit(": "), F.col("n_active").cast("string"), F.lit(" of "), F.col("n_claims").cast("string"), F.lit(" claims active")))
