"""Entities, families, threads, contradictions, gaps and curation from a log over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import knowledge, validation
from .model import Model
from .registry import query


def j(name: str) -> str:
    return f"json_extract_string(payload, '$.{name}')"


def arr(name: str) -> str:
    return f"CAST(json_extract(payload, '$.{name}') AS VARCHAR[])"


def k(*kinds: str) -> str:
    return "event_type IN (" + ", ".join(f"'{x}'" for x in kinds) + ")"


NODES = f"added AS (SELECT {j('id')} AS id, max(seq) AS pos, arg_max({j('label')}, seq) AS label, arg_max({arr('aliases')}, seq) AS aliases, arg_max(run_id, seq) AS run FROM glog WHERE {k('NODE_ADDED')} GROUP BY 1)"


@query(f"""WITH {NODES}, r AS (SELECT {j('targetId')} AS id, max(seq) AS s, arg_max({j('newLabel')}, seq) AS label FROM glog JOIN added ON added.id = {j('targetId')} AND seq > pos WHERE {k('NODE_RELABELED')} GROUP BY 1),
t AS (SELECT added.id, arg_max(run_id, seq) AS run FROM glog JOIN added ON added.id = coalesce({j('targetId')}, {j('survivorId')}) AND seq > pos WHERE {k('NODE_RELABELED', 'NODE_METADATA_UPDATED', 'ENTITY_MERGED')} GROUP BY 1),
w AS (SELECT added.id, list(DISTINCT json_extract_string(payload, '$.mergedSnapshots[0].aliases[0]')) AS more FROM glog JOIN added ON added.id = {j('survivorId')} AND seq > pos WHERE {k('ENTITY_MERGED')} GROUP BY 1),
g AS (SELECT id, max(seq) AS gone FROM (SELECT seq, unnest({arr('mergedIds')}) AS id FROM glog WHERE {k('ENTITY_MERGED')} UNION ALL SELECT seq, {j('originalId')} FROM glog WHERE {k('ENTITY_SPLIT')}) GROUP BY 1)
SELECT added.id, coalesce(r.label, added.label) AS label, array_to_string(list_sort(list_distinct(list_concat(added.aliases, coalesce(more, [])))), ',') AS aliases, coalesce(t.run, added.run) AS last_run
FROM added LEFT JOIN r ON r.id = added.id LEFT JOIN t ON t.id = added.id LEFT JOIN w ON w.id = added.id LEFT JOIN g ON g.id = added.id WHERE gone IS NULL OR gone < pos""")
def pj01_entities(m: Model) -> DataFrame:
    return knowledge.entities(m.glog).withColumn("aliases", F.array_join("aliases", ","))


@query(f"""WITH {NODES} SELECT added.id, {j('field')} AS field, arg_max({j('newValue')}, seq) AS value FROM glog JOIN added ON added.id = {j('targetId')} AND seq > pos WHERE {k('NODE_METADATA_UPDATED')} GROUP BY 1, 2""")
def pj02_entity_fields(m: Model) -> DataFrame:
    return knowledge.entity_fields(m.glog)


@query(f"""SELECT from_id, max(seq) AS seq, arg_max(into_id, seq) AS into_id FROM (SELECT seq, unnest({arr('mergedIds')}) AS from_id, {j('survivorId')} AS into_id FROM glog WHERE {k('ENTITY_MERGED')}
UNION ALL SELECT seq, {j('originalId')}, {j('resultingIds[0]')} FROM glog WHERE {k('ENTITY_SPLIT')}) GROUP BY 1""")
def pj03_merge_history(m: Model) -> DataFrame:
    return knowledge.merge_history(m.glog)


@query(f"SELECT {j('originalId')} AS id, count(*) AS n FROM glog WHERE {k('ENTITY_SPLIT')} AND NOT EXISTS (SELECT 1 FROM glog l WHERE l.event_type = 'NODE_ADDED' AND json_extract_string(l.payload, '$.id') = json_extract_string(glog.payload, '$.originalId') AND l.seq > glog.seq) GROUP BY 1")
def pj04_split_entities(m: Model) -> DataFrame:
    """Entities that a split took away and nothing has added since."""
    split = knowledge.of(m.glog, "ENTITY_SPLIT").select(knowledge.payload("originalId").alias("id"), "seq")
    added = knowledge.of(m.glog, "NODE_ADDED").select(knowledge.payload("id").alias("id"), "seq").groupBy("id").agg(F.max("seq").alias("at"))
    return split.join(added, "id", "left").where("at is null or at < seq").groupBy("id").agg(F.count("*").alias("n"))


@query(f"SELECT id, arg_max(fam, seq) AS family_id, arg_max(conf, seq) AS confidence, 'obs_legacy_' || id AS observation_id, arg_max(timestamp, seq) AS observed_at FROM (SELECT *, {j('id')} AS id, {j('familyId')} AS fam, CAST({j('confidence')} AS DOUBLE) AS conf FROM glog WHERE {k('CLAIM_ACCEPTED')}) GROUP BY id")
def pj05_accepted_claims(m: Model) -> DataFrame:
    return knowledge.accepted_claims(m.glog)


R = "reconciliation."


@query(f"""WITH o AS (SELECT seq, {j(R + 'classification')} AS kind, {j(R + 'canonicalClaimId')} AS f, {j(R + 'matchedClaimId')} AS t, CAST({j(R + 'score')} AS DOUBLE) AS score FROM glog WHERE {k('CLAIM_OBSERVED')}), s AS (SELECT f AS id, min(seq) AS since FROM o GROUP BY 1)
SELECT 'rel_' || CAST(seq AS STRING) AS id, f AS from_id, t AS to_id, CASE kind WHEN 'elaboration' THEN 'elaborates' WHEN 'qualification' THEN 'qualifies' WHEN 'contradiction' THEN 'contradicts' ELSE kind END AS relation, CASE WHEN score >= 0.8 THEN 'strong' ELSE 'weak' END AS strength
FROM o JOIN s ON s.id = o.t AND since < seq WHERE kind IN ('near_duplicate', 'elaboration', 'qualification', 'contradiction')""")
def pj06_derived_relations(m: Model) -> DataFrame:
    return knowledge.derived_relations(m.glog)


@query(f"""WITH o AS (SELECT seq, {j(R + 'canonicalClaimId')} AS id, {j(R + 'classification')} AS kind, run_id IN ('r3', 'r17') AS rolled FROM glog WHERE {k('CLAIM_OBSERVED')}),
a AS (SELECT id, min(seq) AS founder_seq, arg_min(kind, seq) AS kind FROM o WHERE NOT rolled GROUP BY 1), l AS (SELECT id, min(seq) AS lost FROM o WHERE rolled GROUP BY 1)
SELECT a.id, founder_seq, kind = 'same_claim' AND NOT coalesce(lost < founder_seq, false) AS error FROM a LEFT JOIN l ON l.id = a.id""")
def pj07_founders(m: Model) -> DataFrame:
    return knowledge.founders(m.glog.withColumn("rolled", F.col("run_id").isin("r3", "r17")))


@query(f"""WITH b AS (SELECT {j('id')} AS id, max(seq) AS pos, arg_max({j('familyId')}, seq) AS family_id, arg_max({j('claimIdA')}, seq) AS claim_a, arg_max({j('claimIdB')}, seq) AS claim_b FROM glog WHERE {k('CONTRADICTION_IDENTIFIED')} GROUP BY 1),
r AS (SELECT b.id, arg_max({j('newStatus')}, seq) AS status, arg_max(run_id, seq) AS run FROM glog JOIN b ON b.id = {j('contradictionId')} AND seq > pos WHERE {k('CONTRADICTION_RESOLVED')} GROUP BY 1)
SELECT b.id, family_id, claim_a, claim_b, coalesce(status, 'unresolved') AS status, run AS resolved_run FROM b LEFT JOIN r ON r.id = b.id""")
def pj09_contradictions(m: Model) -> DataFrame:
    return knowledge.contradictions(m.glog)


@query(f"""WITH b AS (SELECT {j('id')} AS id, max(seq) AS pos, arg_max({j('familyId')}, seq) AS family_id, arg_max(CAST({j('priority')} AS INT), seq) AS priority FROM glog WHERE {k('GAP_OPENED')} GROUP BY 1),
r AS (SELECT b.id, arg_max({j('newStatus')}, seq) AS status, arg_max(run_id, seq) AS run FROM glog JOIN b ON b.id = {j('gapId')} AND seq > pos WHERE {k('GAP_RESOLVED')} GROUP BY 1)
SELECT b.id, family_id, priority, coalesce(status, 'open') AS status, run AS resolved_run FROM b LEFT JOIN r ON r.id = b.id""")
def pj10_gaps(m: Model) -> DataFrame:
    return knowledge.gaps(m.glog)


@query(f"""SELECT {j('id')} AS id, arg_max({j('url')}, seq) AS url, arg_max(run_id, seq) AS first_run, arg_max(run_id, seq) AS last_run, arg_max(timestamp, seq) AS first_seen_at, arg_max(timestamp, seq) AS last_seen_at, arg_max(coalesce(CAST({j('runCount')} AS INT), 1), seq) AS run_count FROM glog WHERE {k('SOURCE_ADDED')} GROUP BY 1""")
def pj11_added_sources(m: Model) -> DataFrame:
    return knowledge.added_sources(m.glog)


@query(f"""SELECT source_id, x.claimId AS id, len(x.observationIds) AS n_observations, len(x.evidenceIds) AS n_evidence, list_contains(['o0', 'o1'], o) AND o = q AS error FROM (SELECT {j('sourceClaimId')} AS source_id, {j('results[0].observationIds[0]')} AS o, {j('results[1].observationIds[0]')} AS q,
 unnest(from_json(json_extract(payload, '$.results'), '[{{"claimId":"VARCHAR","observationIds":["VARCHAR"],"evidenceIds":["VARCHAR"]}}]')) AS x FROM glog WHERE {k('CLAIM_SPLIT')})""")
def pj17_split_claims(m: Model) -> DataFrame:
    return knowledge.split_claims(m.glog)


@query(f"SELECT {j('target.kind')} AS kind, {j('target.id')} AS id, arg_max({j('newStatus')}, seq) AS status FROM glog WHERE {k('CLAIM_RETRACTION_SET')} GROUP BY 1, 2")
def pj18_retractions(m: Model) -> DataFrame:
    return knowledge.retractions(m.glog)


@query(f"""WITH r AS (SELECT seq, coalesce({j('relationId')}, {j('id')}) AS id, event_type = 'CLAIM_RELATION_CURATED' AS cur, {j('before.relation')} AS b, coalesce({j('after.relation')}, {j('relation')}) AS a FROM glog WHERE {k('EDGE_ADDED', 'CLAIM_RELATION_CURATED')}),
s AS (SELECT *, cur AND b IS DISTINCT FROM lag(a) OVER (PARTITION BY id ORDER BY seq) AS stale FROM r) SELECT id, arg_max(a, seq) AS relation, count(*) FILTER (WHERE stale) AS stale FROM s GROUP BY 1""")
def pj19_curated_relations(m: Model) -> DataFrame:
    return knowledge.curated_relations(m.glog)


@query(f"""WITH b AS (SELECT {j('id')} AS id, max(seq) AS pos, arg_max({j('claimId')}, seq) AS claim_id, arg_max({j('stance')}, seq) AS stance FROM glog WHERE {k('EVIDENCE_LINKED')} GROUP BY 1),
o AS (SELECT b.id, arg_max({j('newStance')}, seq) AS stance FROM glog JOIN b ON b.id = {j('evidenceId')} AND seq > pos WHERE {k('EVIDENCE_STANCE_OVERRIDDEN')} GROUP BY 1) SELECT b.id, claim_id, coalesce(o.stance, b.stance) AS stance FROM b LEFT JOIN o ON o.id = b.id""")
def pj20_stances(m: Model) -> DataFrame:
    return knowledge.stances(m.glog)


@query("""WITH o AS (SELECT l_orderkey AS claim_id, id, observed_at, l_orderkey % 4 = 0 AND l_linenumber = 1 AS legacy, CASE WHEN l_quantity > 40 THEN 'retracted' END AS status FROM
 (SELECT l_orderkey, l_linenumber, l_quantity, CAST(CAST(l_shipdate AS DATE) AS STRING) AS observed_at, CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS id FROM lineitem)),
r AS (SELECT *, bool_or(NOT legacy) OVER (PARTITION BY claim_id) AS real FROM o), a AS (SELECT * FROM r WHERE (NOT legacy OR NOT real) AND status IS NULL), c AS (SELECT claim_id, count(*) AS n_observations, max(observed_at) AS pos FROM a GROUP BY 1),
u AS (SELECT a.claim_id, min(id) AS current_id FROM a JOIN c ON c.claim_id = a.claim_id AND observed_at = pos GROUP BY 1),
e AS (SELECT l_orderkey AS claim_id, count(*) FILTER (WHERE l_returnflag = 'A') AS s, count(*) FILTER (WHERE l_returnflag = 'R') AS o FROM lineitem WHERE l_tax < 0.05 GROUP BY 1)
SELECT c.claim_id, n_observations, current_id, coalesce(s, 0) AS n_supports, coalesce(o, 0) AS n_opposes FROM c JOIN u ON u.claim_id = c.claim_id LEFT JOIN e ON e.claim_id = c.claim_id""")
def pj21_recomputed_claims(m: Model) -> DataFrame:
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    claim = F.col("l_orderkey").alias("claim_id")
    seen = m.lineitem.select(claim, key.alias("id"), F.col("l_shipdate").cast("date").cast("string").alias("observed_at"), F.when(F.col("l_quantity") > 40, F.lit("retracted")).alias("status"), ((F.col("l_orderkey") % 4 == 0) & (F.col("l_linenumber") == 1)).alias("legacy"))
    stance = F.when(F.col("l_returnflag") == "A", F.lit("supports")).when(F.col("l_returnflag") == "R", F.lit("opposes")).otherwise(F.lit("context"))
    return knowledge.recomputed_claims(seen, m.lineitem.select(claim, stance.alias("stance"), (F.col("l_tax") < 0.05).alias("active")))


@query(f"""WITH c AS (SELECT {j('family_id')} AS id, min(seq) AS pos, arg_min({j('label')}, seq) AS label, arg_min(timestamp, seq) AS t FROM glog WHERE {k('FAMILY_CREATED')} GROUP BY 1),
r AS (SELECT c.id, arg_max({j('newLabel')}, seq) AS label FROM glog JOIN c ON c.id = {j('targetId')} AND seq > pos WHERE {k('FAMILY_RENAMED')} GROUP BY 1),
a AS (SELECT c.id, arg_max(timestamp, seq) AS t FROM glog JOIN c ON c.id = coalesce({j('targetId')}, {j('familyId')}, {j('survivorFamilyId')}) AND seq > pos WHERE {k('FAMILY_RENAMED', 'FAMILY_RESOLVED', 'FAMILY_MERGED')} GROUP BY 1),
g AS (SELECT unnest({arr('mergedFamilyIds')}) AS id, max(seq) AS gone FROM glog WHERE {k('FAMILY_MERGED')} GROUP BY 1)
SELECT c.id, coalesce(r.label, c.label) AS label, c.t AS created_at, coalesce(a.t, c.t) AS last_activity FROM c LEFT JOIN r ON r.id = c.id LEFT JOIN a ON a.id = c.id LEFT JOIN g ON g.id = c.id WHERE gone IS NULL OR gone < pos""")
def pj22_families(m: Model) -> DataFrame:
    return knowledge.families(m.glog)


@query(f"""SELECT c.id, count(DISTINCT label) AS n_labels, max(seq) AS last_seq FROM (SELECT {j('family_id')} AS id, {j('label')} AS label, seq FROM glog WHERE {k('FAMILY_CREATED')} UNION ALL SELECT {j('targetId')}, {j('newLabel')}, seq FROM glog WHERE {k('FAMILY_RENAMED')} UNION ALL SELECT {j('familyId')}, NULL, seq FROM glog WHERE {k('FAMILY_RESOLVED')}) c GROUP BY 1""")
def pj23_family_activity(m: Model) -> DataFrame:
    """How often each family was named, and the last that was heard of it."""
    rows = knowledge.of(m.glog, "FAMILY_CREATED", "FAMILY_RENAMED", "FAMILY_RESOLVED")
    p = knowledge.payload
    named = rows.select(F.coalesce(p("family_id"), p("targetId"), p("familyId")).alias("id"), F.coalesce(p("label"), p("newLabel")).alias("label"), "seq")
    return named.groupBy("id").agg(F.countDistinct("label").alias("n_labels"), F.max("seq").alias("last_seq"))


@query(f"""SELECT e AS entity_id, f AS family_id, arg_min(struct_pack(c := conf), seq).c AS confidence FROM (SELECT seq, unnest({arr('entityIds')}) AS e, {j('family_id')} AS f, CAST(NULL AS DOUBLE) AS conf FROM glog WHERE {k('FAMILY_CREATED')}
UNION ALL SELECT seq, {j('entity_id')}, {j('family_id')}, CAST({j('confidence')} AS DOUBLE) FROM glog WHERE {k('FAMILY_CLASSIFIED')}) GROUP BY 1, 2""")
def pj24_memberships(m: Model) -> DataFrame:
    return knowledge.memberships(m.glog)


BOTH_SIDES = f"""t AS (SELECT seq, {j('family_a')} AS a, {j('family_b')} AS b, {j('relation_type')} AS r FROM glog WHERE {k('FAMILY_RELATED')}),
s AS (SELECT * FROM t UNION ALL SELECT seq, b, a, CASE r WHEN 'parent' THEN 'child' WHEN 'child' THEN 'parent' ELSE r END FROM t WHERE r <> 'supersedes')"""


@query(f"WITH {BOTH_SIDES} SELECT a AS family_id, r AS relation, count(DISTINCT b) AS others FROM s GROUP BY 1, 2")
def pj25_related_families(m: Model) -> DataFrame:
    """Families on the other side by relation, removals aside."""
    told = m.glog.where("event_type <> 'FAMILY_RELATION_REMOVED'")
    return knowledge.family_relations(told).groupBy("family_id", "relation").agg(F.countDistinct("other_id").alias("others"))


@query(f"""WITH {BOTH_SIDES}, c AS (SELECT a, b, max(seq) AS cut FROM (SELECT {j('family_a')} AS a, {j('family_b')} AS b, seq FROM glog WHERE {k('FAMILY_RELATION_REMOVED')} UNION ALL SELECT {j('family_b')}, {j('family_a')}, seq FROM glog WHERE {k('FAMILY_RELATION_REMOVED')}) GROUP BY 1, 2)
SELECT DISTINCT s.a AS family_id, s.b AS other_id, r AS relation FROM s LEFT JOIN c ON c.a = s.a AND c.b = s.b WHERE cut IS NULL OR cut < seq""")
def pj26_family_relations(m: Model) -> DataFrame:
    return knowledge.family_relations(m.glog)


MOVES = f"""m AS (SELECT x AS id, min(y) AS t FROM (SELECT unnest({arr('mergedFamilyIds')}) AS x, {j('survivorFamilyId')} AS y FROM glog WHERE {k('FAMILY_MERGED')}) WHERE x <> y GROUP BY 1), ends AS (SELECT m.id, coalesce(n.t, m.t) AS t FROM m LEFT JOIN m n ON n.id = m.t)"""


@query(f"WITH {MOVES} SELECT id, t AS survivor FROM ends")
def pj27_family_survivors(m: Model) -> DataFrame:
    merged = knowledge.of(m.glog, "FAMILY_MERGED").select(F.explode(knowledge.texts("mergedFamilyIds")).alias("id"), knowledge.payload("survivorFamilyId").alias("to"))
    return knowledge.aliases(merged).withColumnRenamed("to", "survivor")


@query(f"""WITH {MOVES}, c AS (SELECT {j('threadId')} AS id, min(seq) AS pos, arg_min({j('familyId')}, seq) AS fam, arg_min({j('label')}, seq) AS label FROM glog WHERE {k('THREAD_CREATED')} GROUP BY 1), d AS (SELECT {j('threadId')} AS id, max(seq) AS done FROM glog WHERE {k('THREAD_RESOLVED')} GROUP BY 1)
SELECT c.id, coalesce(ends.t, fam) AS family_id, label, CASE WHEN done > pos THEN 'resolved' ELSE 'open' END AS status FROM c LEFT JOIN ends ON ends.id = fam LEFT JOIN d ON d.id = c.id""")
def pj28_threads(m: Model) -> DataFrame:
    return knowledge.threads(m.glog)


@query("SELECT l_orderkey AS claim_id, array_to_string(list(CAST(CAST(round(l_discount * 100) AS INT) AS STRING) ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_discount), ',') AS points FROM lineitem GROUP BY 1")
def wn05_confidence_history(m: Model) -> DataFrame:
    point = F.round(F.col("l_discount") * 100).cast("int")
    rows = m.lineitem.select(F.col("l_orderkey").alias("claim_id"), F.col("l_shipdate").alias("observed_at"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_discount").alias("id"), point.alias("confidence"))
    return knowledge.confidence_history(rows).select("claim_id", F.array_join(F.transform("points", lambda p: p.cast("string")), ",").alias("points"))


# --- what the log may hold, and whether it holds together ---


@query(f"""WITH f AS (SELECT {j('family_id')} AS id, min(seq) AS since FROM glog WHERE {k('FAMILY_CREATED')} GROUP BY 1), n AS (SELECT {j('id')} AS id, min(seq) AS since FROM glog WHERE {k('NODE_ADDED')} GROUP BY 1),
x AS (SELECT {j('id')} AS id, min(seq) AS since FROM glog WHERE {k('CONTRADICTION_IDENTIFIED')} GROUP BY 1), g AS (SELECT {j('id')} AS id, min(seq) AS since FROM glog WHERE {k('GAP_OPENED')} GROUP BY 1), t AS (SELECT {j('threadId')} AS id, min(seq) AS since FROM glog WHERE {k('THREAD_CREATED')} GROUP BY 1),
v AS (SELECT {j('id')} AS id, min(seq) AS since FROM glog WHERE {k('EVIDENCE_LINKED')} GROUP BY 1),
refs AS (SELECT seq, event_type, 'family' AS kind, {j('targetId')} AS ref FROM glog WHERE {k('FAMILY_RENAMED')} UNION ALL SELECT seq, event_type, 'family', {j('family_id')} FROM glog WHERE {k('FAMILY_CLASSIFIED')} UNION ALL SELECT seq, event_type, 'family', {j('family_a')} FROM glog WHERE {k('FAMILY_RELATED', 'FAMILY_RELATION_REMOVED')}
 UNION ALL SELECT seq, event_type, 'family', {j('family_b')} FROM glog WHERE {k('FAMILY_RELATED', 'FAMILY_RELATION_REMOVED')} UNION ALL SELECT seq, event_type, 'family', {j('survivorFamilyId')} FROM glog WHERE {k('FAMILY_MERGED')} UNION ALL SELECT seq, event_type, 'family', unnest({arr('mergedFamilyIds')}) FROM glog WHERE {k('FAMILY_MERGED')}
 UNION ALL SELECT seq, event_type, 'family', {j('familyId')} FROM glog WHERE {k('THREAD_CREATED', 'CLAIM_ACCEPTED', 'CONTRADICTION_IDENTIFIED', 'GAP_OPENED')}
 UNION ALL SELECT seq, event_type, 'entity', {j('targetId')} FROM glog WHERE {k('NODE_RELABELED', 'NODE_METADATA_UPDATED')} UNION ALL SELECT seq, event_type, 'entity', {j('entity_id')} FROM glog WHERE {k('FAMILY_CLASSIFIED')} UNION ALL SELECT seq, event_type, 'entity', {j('survivorId')} FROM glog WHERE {k('ENTITY_MERGED')}
 UNION ALL SELECT seq, event_type, 'entity', unnest({arr('mergedIds')}) FROM glog WHERE {k('ENTITY_MERGED')} UNION ALL SELECT seq, event_type, 'entity', {j('originalId')} FROM glog WHERE {k('ENTITY_SPLIT')}
 UNION ALL SELECT seq, event_type, 'contradiction', {j('contradictionId')} FROM glog WHERE {k('CONTRADICTION_RESOLVED')} UNION ALL SELECT seq, event_type, 'gap', {j('gapId')} FROM glog WHERE {k('GAP_RESOLVED')} UNION ALL SELECT seq, event_type, 'thread', {j('threadId')} FROM glog WHERE {k('THREAD_RESOLVED')}
 UNION ALL SELECT seq, event_type, 'evidence', {j('evidenceId')} FROM glog WHERE {k('EVIDENCE_STANCE_OVERRIDDEN')}),
known AS (SELECT 'family' AS kind, * FROM f UNION ALL SELECT 'entity', * FROM n UNION ALL SELECT 'contradiction', * FROM x UNION ALL SELECT 'gap', * FROM g UNION ALL SELECT 'thread', * FROM t UNION ALL SELECT 'evidence', * FROM v)
SELECT DISTINCT r.seq, r.event_type, r.kind, r.ref FROM refs r LEFT JOIN known ON known.kind = r.kind AND known.id = r.ref AND since < r.seq WHERE known.id IS NULL""")
def snk03_dangling_references(m: Model) -> DataFrame:
    return validation.dangling(m.glog, ("family", "entity", "contradiction", "gap", "thread", "evidence"))


@query("""SELECT 'claim family' AS problem, CAST(o_orderkey AS STRING) AS id FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 9 > 0 WHERE c_custkey IS NULL
UNION ALL SELECT 'evidence claim', CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL
UNION ALL SELECT 'thread family', CAST(s_suppkey AS STRING) FROM supplier WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = s_nationkey * 9 AND c_custkey % 9 > 0)
UNION ALL SELECT 'claim thread', CAST(o_orderkey AS STRING) FROM orders LEFT JOIN supplier ON s_suppkey = o_orderkey % 7 + 1 WHERE o_orderkey % 5 = 0 AND s_nationkey * 9 IS DISTINCT FROM o_custkey
UNION ALL SELECT 'relation', CAST(p_partkey AS STRING) FROM part WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = p_partkey) OR NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = p_partkey * 90)""")
def snk04_projection_references(m: Model) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    views = {
        "families": m.customer.where("c_custkey % 9 > 0").select(F.col("c_custkey").alias("id")),
        "threads": m.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") * 9).alias("family_id")),
        "claims": m.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("family_id"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") % 7 + 1).alias("thread_id")),
        "evidence": m.lineitem.select(F.concat_ws("-", text("l_orderkey"), text("l_linenumber")).alias("id"), F.col("l_orderkey").alias("claim_id")),
        "relations": m.part.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("from_id"), (F.col("p_partkey") * 90).alias("to_id")),
    }
    return validation.projection_problems(views)


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'EVENT_TYPE_UNKNOWN' WHEN 1 THEN 'EVENT_VERSION_UNSUPPORTED' WHEN 2 THEN 'EVENT_PAYLOAD_INVALID' END AS error, CASE WHEN event_id % 6 > 2 THEN 'L' || CAST(event_id AS STRING) END AS label FROM events""")
def snk02_decoded(m: Model) -> DataFrame:
    n = F.col("event_id") % 6
    label = F.concat(F.lit("L"), F.col("event_id").cast("string"))
    rows = m.events.select(
        "event_id", F.when(n == 0, F.lit("NO_SUCH")).otherwise(F.lit("NODE_RELABELED")).alias("event_type"), F.when(n == 1, 9).when(n == 3, 2).otherwise(1).alias("version"),
        F.when(n == 2, F.lit('{"targetId":5}')).when(n == 3, F.to_json(F.struct(F.lit("t").alias("targetId"), F.lit("o").alias("oldLabel"), label.alias("newLabel"), F.lit(1).alias("weight"))))
        .otherwise(F.to_json(F.struct(F.lit("t").alias("targetId"), F.lit("o").alias("oldLabel"), label.alias("newLabel")))).alias("payload"),
    )
    decoded = validation.decoded(rows, validation.example_codecs())
    return decoded.select("event_id", "error", F.when(F.col("error").isNull(), F.get_json_object("payload", "$.newLabel")).alias("label"))


@query(f"""SELECT 'entities' AS view, count(*) AS n FROM (WITH {NODES}, g AS (SELECT id, max(seq) AS gone FROM (SELECT seq, unnest({arr('mergedIds')}) AS id FROM glog WHERE {k('ENTITY_MERGED')} UNION ALL SELECT seq, {j('originalId')} FROM glog WHERE {k('ENTITY_SPLIT')}) GROUP BY 1) SELECT added.id FROM added LEFT JOIN g ON g.id = added.id WHERE gone IS NULL OR gone < pos)
UNION ALL SELECT 'claims', count(DISTINCT {j('id')}) FROM glog WHERE {k('CLAIM_ACCEPTED')} UNION ALL SELECT 'evidence', count(DISTINCT {j('id')}) FROM glog WHERE {k('EVIDENCE_LINKED')} UNION ALL SELECT 'contradictions', count(DISTINCT {j('id')}) FROM glog WHERE {k('CONTRADICTION_IDENTIFIED')}
UNION ALL SELECT 'gaps', count(DISTINCT {j('id')}) FROM glog WHERE {k('GAP_OPENED')} UNION ALL SELECT 'sources', count(DISTINCT {j('id')}) FROM glog WHERE {k('SOURCE_ADDED')} UNION ALL SELECT 'threads', count(DISTINCT {j('threadId')}) FROM glog WHERE {k('THREAD_CREATED')}""")
def snk06_rebuilt(m: Model) -> DataFrame:
    """Rows of the views that a rebuild makes."""
    names = ("entities", "claims", "evidence", "contradictions", "gaps", "sources", "threads")
    out = None
    for name, view in knowledge.rebuild(m.glog, {n: knowledge.REGISTRY[n] for n in names}).items():
        one = view.agg(F.count("*").alias("n")).select(F.lit(name).alias("view"), "n")
        out = one if out is None else out.union(one)
    return out


@query(f"""WITH l AS (SELECT *, seq % 1000 = 1 AS bad FROM glog), g AS (SELECT {j('id')} AS id, min(seq) AS since FROM glog WHERE {k('GAP_OPENED')} GROUP BY 1), x AS (SELECT count(*) FILTER (WHERE bad) AS h, count(*) FILTER (WHERE event_type = 'NODE_RELABELED') AS c FROM l),
r AS (SELECT count(DISTINCT glog.seq) AS n FROM glog LEFT JOIN g ON g.id = {j('gapId')} AND since < seq WHERE {k('GAP_RESOLVED')} AND g.id IS NULL), p AS (SELECT count(*) AS n FROM (SELECT DISTINCT {j('id')} AS id FROM glog WHERE {k('GAP_OPENED')}) WHERE CAST(substr(id, 2) AS INT) % 10 = 3)
SELECT 'payload hashes' AS "check", CASE WHEN h > 0 THEN 'error' ELSE 'ok' END AS severity, h AS n FROM x UNION ALL SELECT 'payload codecs', CASE WHEN c > 0 THEN 'error' ELSE 'ok' END, c FROM x UNION ALL SELECT 'references', CASE WHEN n > 0 THEN 'error' ELSE 'ok' END, n FROM r UNION ALL SELECT 'read model', CASE WHEN n > 0 THEN 'error' ELSE 'ok' END, n FROM p""")
def chk06_verify(m: Model) -> DataFrame:
    """All checks of a log whose every thousandth hash is wrong and whose relabellings lack a field, against a view without a tenth of its rows."""
    log = m.glog.withColumns({"payload_hash": F.when(F.col("seq") % 1000 == 1, F.lit("x")).otherwise(F.sha2(F.col("payload").cast("binary"), 256)), "event_version": F.lit(1)})
    gaps = knowledge.gaps(m.glog).select("id", "priority")
    return validation.verified(log, validation.example_codecs(), gaps.where("cast(substr(id, 2, 10) as int) % 10 <> 3"), gaps, kinds=("gap",))
