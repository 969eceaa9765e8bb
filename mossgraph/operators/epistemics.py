"""Confidence, contradiction state, independence of sources, support level and status of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import EVIDENCE_WEIGHT, authority_weight, freshness
from .graph import components, saved


#: Links of a claim up to which its groups are found in one expression; claims with more are worked on as a graph.
SMALL = 64


def _groups(links: Column) -> Column:
    """How many groups ``links``, an array of arrays, form where those that share a member are one."""
    none = F.array().cast("array<array<bigint>>")
    meet = lambda found, names: F.filter(found, lambda g: F.arrays_overlap(g, names))
    apart = lambda found, names: F.filter(found, lambda g: ~F.arrays_overlap(g, names))
    return F.size(F.aggregate(links, none, lambda found, names: F.concat(apart(found, names), F.array(F.array_distinct(F.flatten(F.concat(meet(found, names), F.array(names))))))))


def independent_sources(links: DataFrame) -> DataFrame:
    """``links(claim_id, domain, content)`` -> ``(claim_id, n_independent)``: groups of domains tied by equal content.

    Domains and contents of a claim form a bipartite graph; rows without content are domains on their own.  Claims with few links are
    solved where they are gathered; only those with more than ``SMALL`` go through the rounds of ``components``."""
    domain = F.xxhash64("claim_id", F.lit("domain"), "domain")
    content = F.when(F.col("content").isNotNull(), F.xxhash64("claim_id", F.lit("content"), "content"))
    rows = saved(links.where(F.col("domain").isNotNull()).select("claim_id", domain.alias("a"), content.alias("b")))
    large = saved(rows.groupBy("claim_id").agg(F.count("*").alias("_n")).where(F.col("_n") > SMALL).select("claim_id"))
    none = large.isEmpty()
    ties = F.when(F.col("b").isNull(), F.array("a")).otherwise(F.array("a", "b"))
    named = large.withColumnRenamed("claim_id", "_claim")
    of_large = F.col("claim_id").eqNullSafe(F.col("_claim"))
    few = rows if none else rows.join(named, of_large, "left_anti")
    small = few.groupBy("claim_id").agg(_groups(F.collect_set(ties)).cast("long").alias("n_independent"))
    return small if none else small.union(_independent_by_graph(rows.join(named, of_large, "left_semi")))


def _independent_by_graph(links: DataFrame) -> DataFrame:
    """``links(claim_id, a, b)`` of domains and contents that no two claims have in common, as ``independent_sources`` counts them."""
    rows = links.distinct()
    # a content of one domain ties nothing
    tying = rows.where("b is not null").groupBy("b").agg(F.count("*").alias("_n")).where("_n > 1").select("b")
    found = components(rows.join(tying, "b").select("a", "b"))
    joined = rows.select("claim_id", F.col("a").alias("node")).distinct().join(found.withColumnRenamed("id", "node"), "node", "left")
    return joined.groupBy("claim_id").agg(F.countDistinct(F.coalesce("component", "node")).alias("n_independent"))


def active_evidence(evidence: DataFrame, observations: DataFrame) -> DataFrame:
    """``evidence`` without that of a retracted observation; evidence of none, or of an unknown one, counts."""
    gone = observations.where("status = 'retracted'").select(F.col("id").alias("observation_id"))
    return evidence.join(gone, "observation_id", "left_anti")


def contradiction_state(claims: DataFrame, evidence: DataFrame, contradictions: DataFrame) -> DataFrame:
    """``(claim_id, contradiction_state, n_evidence, n_supports, n_opposes)``.

    ``contested`` by an unresolved record, ``resolved`` if all records of the claim are, else ``contested`` if evidence both supports and
    opposes it.  ``evidence`` is what counts; ``contradictions(claim_a, claim_b, status)``, where no status is unresolved."""
    ends = contradictions.select(F.explode(F.array_distinct(F.array("claim_a", "claim_b"))).alias("claim_id"), (F.coalesce("status", F.lit("unresolved")) == "unresolved").alias("_open"))
    records = ends.groupBy("claim_id").agg(F.bool_or("_open").alias("_open"))
    counts = evidence.groupBy("claim_id").agg(F.count("*").alias("n_evidence"), F.count_if(F.col("stance") == "supports").alias("n_supports"), F.count_if(F.col("stance") == "opposes").alias("n_opposes"))
    rows = claims.select(F.col("id").alias("claim_id")).join(records, "claim_id", "left").join(counts, "claim_id", "left").na.fill(0, ["n_evidence", "n_supports", "n_opposes"])
    mixed = (F.col("n_supports") > 0) & (F.col("n_opposes") > 0)
    state = F.when(F.col("_open"), F.lit("contested")).when(~F.col("_open"), F.lit("resolved")).when(mixed, F.lit("contested")).otherwise(F.lit("none"))
    return rows.select("claim_id", state.alias("contradiction_state"), "n_evidence", "n_supports", "n_opposes")


def epistemic_state(claims: DataFrame, observations: DataFrame, evidence: DataFrame, sources: DataFrame, contradictions: DataFrame, as_of: str) -> DataFrame:
    """``(claim_id, confidence, contradiction_state, support_level, epistemic_status, n_independent)`` of every claim.

    ``observations(id, claim_id, confidence, evidence_type, authority_class, observed_at, source_ids, status)``: retracted ones do not
    count.  An observation has its own authority or that of the first of its sources that has one; it is as fresh as the latest of
    its sources, by date of publication, else of retrieval, or as itself where they have neither.
    ``evidence(id, claim_id, source_id, observation_id, stance, excerpt)``; ``sources(id, domain, authority_class, published_at,
    retrieved_at, content_hash)``.  Consensus takes two observations and two independent sources: domains tied by equal content,
    the hash or else the first excerpt, are one.  Everything is summed by claim or observation before it is joined."""
    counted = observations.where("coalesce(status, 'active') = 'active'")
    usable = saved(active_evidence(evidence, observations).select("id", "claim_id", "source_id", "stance", "excerpt"))
    known = sources.select(F.col("id").alias("source_id"), "domain", F.col("authority_class").alias("_authority"), F.coalesce("published_at", "retrieved_at").cast("timestamp").alias("_at"), "content_hash")
    cited = counted.select(F.col("id").alias("observation"), F.col("claim_id"), F.posexplode("source_ids").alias("_place", "source_id")).join(known, "source_id")
    of_sources = cited.groupBy("observation").agg(F.min_by("_authority", F.when(F.col("_authority").isNotNull(), F.col("_place"))).alias("_theirs"), F.max("_at").alias("_latest"))
    kinds = F.create_map(*[F.lit(x) for pair in EVIDENCE_WEIGHT.items() for x in pair])
    authority = authority_weight(F.coalesce("authority_class", "_theirs"))
    weight = authority * F.try_element_at(kinds, F.col("evidence_type")) * freshness(F.coalesce("_latest", F.col("observed_at").cast("timestamp")), F.lit(as_of).cast("timestamp"))
    weighed = counted.join(of_sources.withColumnRenamed("observation", "id"), "id", "left").withColumns({"_a": authority, "_w": weight})
    o = weighed.groupBy("claim_id").agg(F.count("*").alias("n_obs"), F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("confidence")).alias("wc"), F.max("_a").alias("best"))
    e = usable.where("stance = 'opposes'").join(known.select("source_id", "_authority"), "source_id", "left").groupBy("claim_id").agg(F.sum(authority_weight(F.col("_authority"))).alias("opposing"))
    told = usable.select("claim_id", "source_id", F.when((F.col("excerpt") != "") & F.col("id").isNotNull(), F.struct("id", "excerpt")).alias("_told"))
    cites = counted.select("claim_id", F.explode("source_ids").alias("source_id"), F.lit(None).cast(told.schema["_told"].dataType).alias("_told"))
    named = cites.union(told).groupBy("claim_id", "source_id").agg(F.min("_told").alias("_told")).join(known.where("domain <> ''").select("source_id", "domain", "content_hash"), "source_id")
    independent = independent_sources(named.select("claim_id", "domain", F.coalesce("content_hash", "_told.excerpt").alias("content")))
    rows = contradiction_state(claims, usable, contradictions).join(o, "claim_id", "left").join(e, "claim_id", "left").join(independent, "claim_id", "left").na.fill(0)
    base = F.coalesce(F.try_divide("wc", "w"), F.lit(0.0))
    against = (F.col("n_opposes") > 0) & ((F.col("n_supports") > 0) | (F.col("n_obs") > 0))
    penalty = F.when(against, F.least(F.col("opposing") / F.greatest("n_supports", F.lit(1)), F.lit(0.8))).otherwise(F.lit(0.0))
    confidence = F.round(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base * (1 - penalty))), 9), 3)
    contested = F.col("contradiction_state") == "contested"
    status = (
        F.when(F.col("n_obs") == 0, F.lit("unknown")).when(contested, F.lit("contested"))
        .when((F.col("n_obs") >= 2) & (F.col("n_independent") >= 2), F.lit("consensus"))
        .when((F.col("n_evidence") > 0) | (F.col("n_obs") >= 2), F.lit("emerging")).otherwise(F.lit("speculative"))
    )
    support = F.when(contested, F.lit("conflicting")).when((F.col("n_obs") > 0) & (F.col("best") >= 0.85), F.lit("primary")).when((F.col("n_obs") > 0) & (F.col("best") >= 0.6), F.lit("secondary")).otherwise(F.lit("weak"))
    return rows.select("claim_id", confidence.alias("confidence"), "contradiction_state", support.alias("support_level"), status.alias("epistemic_status"), "n_independent")
