"""Feeds, leases, digests, snapshots, evidence and cases over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..api import Knowledge, Runs
from ..operators import evaluate, feeds, knowledge, ledger, projection, reconcile, research
from ..sources import archive
from .knowledge_queries import MOVES, j, k
from .model import Model
from .registry import query
from .text_queries import _assertions
from .wording_queries import CONTENT, pick

TOLD = f"""CASE event_type WHEN 'CLAIM_OBSERVED' THEN CASE WHEN {j('reconciliation.classification')} = 'new_claim' THEN 'New' ELSE 'Updated' END || ' claim: unknown' WHEN 'EVIDENCE_LINKED' THEN 'Evidence linked to claim ' || {j('claimId')}
 WHEN 'CONTRADICTION_IDENTIFIED' THEN 'Contradiction identified between claims ' || {j('claimIdA')} || ' and ' || {j('claimIdB')} WHEN 'CONTRADICTION_RESOLVED' THEN 'Contradiction resolved: ' || {j('contradictionId')} WHEN 'GAP_OPENED' THEN 'Gap opened: unknown'
 WHEN 'GAP_RESOLVED' THEN 'Gap resolved: ' || {j('gapId')} WHEN 'CLAIM_SPLIT' THEN 'Claim split' WHEN 'CLAIM_RETRACTION_SET' THEN 'Claim retraction changed' WHEN 'CLAIM_RELATION_CURATED' THEN 'Claim relation curated' WHEN 'EVIDENCE_STANCE_OVERRIDDEN' THEN 'Evidence stance overridden' ELSE event_type END"""


@query(f"SELECT seq, {TOLD} AS line FROM glog")
def fn34_told_events(m: Model) -> DataFrame:
    return m.glog.select("seq", feeds.told().alias("line"))


@query(f"""SELECT seq, CASE WHEN event_type = 'CLAIM_OBSERVED' THEN CASE {j('reconciliation.classification')} WHEN 'supersedes' THEN 'supersededClaims' WHEN 'new_claim' THEN 'newClaims' ELSE 'updatedClaims' END WHEN event_type = 'EVIDENCE_LINKED' THEN 'newEvidence' WHEN event_type = 'CONTRADICTION_IDENTIFIED' THEN 'contradictionsOpened'
 WHEN event_type = 'CONTRADICTION_RESOLVED' THEN 'contradictionsResolved' WHEN event_type = 'GAP_OPENED' THEN 'gapsOpened' WHEN event_type = 'GAP_RESOLVED' THEN 'gapsResolved' WHEN {k('CLAIM_SPLIT', 'CLAIM_RETRACTION_SET', 'CLAIM_RELATION_CURATED', 'EVIDENCE_STANCE_OVERRIDDEN')} THEN 'curationEvents' ELSE 'otherEvents' END AS bucket FROM glog""")
def fn35_change_buckets(m: Model) -> DataFrame:
    return m.glog.select("seq", feeds.bucket().alias("bucket"))


@query(f"""WITH c AS (SELECT {j('id')} AS claim_id, arg_max({j('familyId')}, seq) AS family_id FROM glog WHERE {k('CLAIM_ACCEPTED')} GROUP BY 1), r AS (SELECT DISTINCT seq, unnest([{j('claimId')}, {j('claimIdA')}, {j('claimIdB')}, {j('sourceClaimId')}, {j('fromClaimId')}, {j('toClaimId')}, {j('reconciliation.canonicalClaimId')}]) AS claim_id FROM glog)
SELECT DISTINCT seq, family_id FROM (SELECT seq, coalesce({j('familyId')}, {j('family_id')}) AS family_id FROM glog UNION ALL SELECT r.seq, c.family_id FROM r JOIN c ON c.claim_id = r.claim_id) WHERE family_id IS NOT NULL""")
def jn06_owning_families(m: Model) -> DataFrame:
    claims = knowledge.accepted_claims(m.glog).select(F.col("id").alias("claim_id"), "family_id")
    return feeds.owning_families(m.glog, claims)


@query("""WITH r AS (SELECT event_id // 7 AS run_id, max(ts) AS last, bool_or(event_type = 'purchase') AS done, bool_or(event_type = 'error') AS asked, bool_or(event_type = 'click') AS ran FROM events GROUP BY 1), n AS (SELECT max(ts) AS t FROM events)
SELECT run_id, CASE WHEN epoch(t) - epoch(last) <= 60 THEN 'alive' WHEN asked THEN 'cancel' WHEN NOT ran THEN 'resume' ELSE 'interrupt' END AS verdict FROM r, n WHERE NOT done""")
def str05_leases(m: Model) -> DataFrame:
    now = m.events.agg(F.max("ts")).first()[0]
    kind = F.when(F.col("event_type") == "purchase", F.lit("RUN_COMPLETED")).when(F.col("event_type") == "error", F.lit("RUN_CANCELLATION_REQUESTED")).when(F.col("event_type") == "click", F.lit("RUN_RUNNING")).otherwise(F.lit("RUN_HEARTBEAT"))
    return feeds.leases(m.events.select(F.floor(F.col("event_id") / 7).cast("long").alias("run_id"), F.col("ts").alias("at"), kind.alias("event_type")), F.lit(now).cast("timestamp"))


@query()
def str07_throttled(m: Model) -> DataFrame:
    """Progress of runs told once an hour, at each new phase and at the end; tested by a fold."""
    return feeds.throttled(m.events.select(F.col("user_id").cast("long").alias("run_id"), F.col("event_id").alias("seq"), F.unix_timestamp("ts").alias("at"), (F.col("event_id") % 100 > 90).cast("string").alias("phase")), 3600.0)


@query()
def str08_breaker(m: Model) -> DataFrame:
    """A circuit breaker for each user, a quarter of an hour to cool; tested by a fold."""
    failed = F.col("event_type").isin("error", "click", "view")
    return ledger.breaker_states(m.events.select(F.col("user_id").cast("long").alias("key"), F.col("event_id").alias("seq"), F.unix_timestamp("ts").alias("at"), failed.alias("failed")), cool=900.0)


@query("""WITH e AS (SELECT run_id, min(seq) AS stop FROM log WHERE event_type IN ('RUN_COMPLETED', 'RUN_FAILED') GROUP BY 1) SELECT l.run_id, l.seq FROM log l LEFT JOIN e ON e.run_id = l.run_id WHERE l.seq > 100 AND (stop IS NULL OR l.seq <= stop)""")
def str03_run_tail(m: Model) -> DataFrame:
    return feeds.until_terminal(m.log, 100).select("run_id", "seq")


@query("SELECT CASE WHEN event_type IN ('CLAIM_SPLIT', 'CLAIM_RETRACTION_SET', 'CLAIM_RELATION_CURATED', 'EVIDENCE_STANCE_OVERRIDDEN', 'ENTITY_MERGED', 'ENTITY_SPLIT', 'FAMILY_MERGED') THEN 'dirty' WHEN event_type IN ('NODE_ADDED', 'NODE_RELABELED', 'NODE_METADATA_UPDATED') THEN 'entities' WHEN event_type IN ('FAMILY_CREATED', 'FAMILY_RENAMED', 'FAMILY_RESOLVED') THEN 'families' WHEN event_type LIKE 'THREAD%' THEN 'threads' WHEN event_type LIKE 'CONTRADICTION%' THEN 'contradictions' WHEN event_type LIKE 'GAP%' THEN 'gaps' WHEN event_type = 'SOURCE_ADDED' THEN 'sources' WHEN event_type = 'EVIDENCE_LINKED' THEN 'evidence' WHEN event_type = 'CLAIM_ACCEPTED' THEN 'claims' END AS view, count(DISTINCT CASE WHEN event_type IN ('CLAIM_SPLIT', 'CLAIM_RETRACTION_SET', 'CLAIM_RELATION_CURATED', 'EVIDENCE_STANCE_OVERRIDDEN', 'ENTITY_MERGED', 'ENTITY_SPLIT', 'FAMILY_MERGED') THEN 'x' ELSE coalesce("
       + ", ".join(j(x) for x in ("id", "targetId", "family_id", "familyId", "threadId", "contradictionId", "gapId")).replace(j("familyId"), f"CASE WHEN event_type = 'FAMILY_RESOLVED' THEN {j('familyId')} END") + ") END) AS n FROM glog WHERE event_type NOT IN ('FAMILY_CLASSIFIED', 'FAMILY_RELATED', 'FAMILY_RELATION_REMOVED', 'CLAIM_OBSERVED', 'EDGE_ADDED') GROUP BY 1")
def snk05_affected(m: Model) -> DataFrame:
    """How many rows of each view the log's events change; 1 where only a rebuild will do."""
    return archive.affected(m.glog).groupBy("view").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS value FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderkey % 7 = 0)""")
def str02_upserted(m: Model) -> DataFrame:
    """A stored view with the rows that a batch affected derived anew: a third of them, of which every seventh is gone."""
    stored = m.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    derived = stored.where("id % 7 <> 0").withColumn("value", F.col("value") * 2)
    return archive.upserted(stored, derived, stored.where("id % 3 = 0").select("id"))


@query("""SELECT s_suppkey AS id, coalesce(CASE WHEN s_acctbal < 0 THEN 'retracted' END, 'active') AS curation, sha256('{"count":0,"curation":"' || CASE WHEN s_acctbal < 0 THEN 'retracted' ELSE 'active' END || '","id":' || CAST(s_suppkey AS STRING) || CASE WHEN s_suppkey % 2 = 0 THEN ',"title":"' || s_name || '"' ELSE '' END || '}') AS digest FROM supplier""")
def snk07_serialised(m: Model) -> DataFrame:
    rows = m.supplier.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") < 0, F.lit("retracted")).alias("curation"), F.lit(None).cast("int").alias("count"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("title"))
    out = archive.serialised(rows, {"curation": "active", "count": 0})
    return out.select("id", "curation", F.sha2(F.col("row_json").cast("binary"), 256).alias("digest"))


@query("""SELECT block, count(*) AS n, max(seq) AS last_seq, sha256(string_agg(line || chr(10), '' ORDER BY seq)) AS sha256 FROM (SELECT event_id // 100000 AS block, event_id AS seq, '{"event_type":"' || event_type || '","seq":' || CAST(event_id AS STRING) || ',"user":' || CAST(user_id AS STRING) || '}' AS line FROM events) GROUP BY 1""")
def snk11_block_digests(m: Model) -> DataFrame:
    return archive.block_digests(m.events.select(F.col("event_id").alias("seq"), "event_type", F.col("user_id").alias("user")))


@query("""WITH w AS (SELECT o_custkey AS run_id, o_orderkey AS ord, o_orderkey % 5 = 0 AS deleted, o_orderkey % 3 AS format, CASE WHEN o_orderkey % 7 = 0 THEN 'broken' ELSE '{"n":' || CAST(o_orderkey AS STRING) || '}' END AS body FROM orders), l AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ord DESC) AS n FROM w)
SELECT run_id, format, body FROM l WHERE n = 1 AND NOT deleted AND format <= 1 AND body <> 'broken'""")
def snk12_step_checkpoints(m: Model) -> DataFrame:
    n = F.col("o_orderkey")
    body = F.when(n % 7 == 0, F.lit("broken")).otherwise(F.concat(F.lit('{"n":'), n.cast("string"), F.lit("}")))
    return archive.step_checkpoints(m.orders.select(F.col("o_custkey").alias("run_id"), n.alias("ord"), (n % 5 == 0).alias("deleted"), (n % 3).alias("format"), body.alias("body")), 1)


@query(f"SELECT id, arg_max(label, seq) AS label, max(seq) AS last_seq FROM (SELECT seq, coalesce({j('targetId')}, {j('id')}) AS id, coalesce({j('newLabel')}, {j('label')}) AS label FROM glog WHERE {k('NODE_ADDED', 'NODE_RELABELED')}) GROUP BY 1")
def rep05_incremental(m: Model) -> DataFrame:
    """Labels of entities from a snapshot at the middle of the log and the events since; the same as from all events."""
    events = knowledge.of(m.glog, "NODE_ADDED", "NODE_RELABELED")
    view = lambda e: projection.last_writer(e, F.coalesce(projection.payload("targetId"), projection.payload("id")), label=F.coalesce(projection.payload("newLabel"), projection.payload("label"))).drop("first_seq")
    middle = events.agg(F.expr("cast((min(seq) + max(seq)) / 2 as long)")).first()[0] or 0
    return archive.refreshed(view(events.where(F.col("seq") <= middle)), view(events.where(F.col("seq") > middle)))


# --- evidence ---


def _evidence(m: Model) -> DataFrame:
    n = F.col("item_id")
    claim = F.concat(F.lit("Version "), (n % 5).cast("string"), F.lit(".2 of March 3, 2024: "), F.array_join(F.slice(F.split("text", " "), 1, 6), " "))
    said = F.when(n % 3 == 0, F.concat(F.lit("released version "), (n % 5).cast("string"), F.lit(".2 on march 3, 2024 "), "text")).when(n % 3 == 1, F.concat(F.lit("version 9.9 "), "text")).otherwise(F.lit(""))
    return m.benchmark.select("item_id", claim.alias("claim"), said.alias("evidence"))


EVIDENCE = rf"""v AS (SELECT item_id, 'Version ' || CAST(item_id % 5 AS STRING) || '.2 of March 3, 2024: ' || array_to_string(string_split(text, ' ')[1:6], ' ') AS c, CASE item_id % 3 WHEN 0 THEN 'released version ' || CAST(item_id % 5 AS STRING) || '.2 on march 3, 2024 ' || text WHEN 1 THEN 'version 9.9 ' || text ELSE '' END AS e FROM benchmark),
t AS (SELECT item_id, c, e, list_distinct(list_filter(list_transform(string_split_regex(lower(c), '[^a-z0-9@._/\-]+'), lambda t: regexp_replace(t, '^[._/\-]+|[._/\-]+$', '', 'g')), lambda t: len(t) > 2 AND t NOT IN {CONTENT})) AS x,
 list_distinct(list_filter(list_transform(string_split_regex(lower(e), '[^a-z0-9@._/\-]+'), lambda t: regexp_replace(t, '^[._/\-]+|[._/\-]+$', '', 'g')), lambda t: len(t) > 2 AND t NOT IN {CONTENT})) AS y,
 list_distinct(list_transform(list_concat(regexp_extract_all(c, '(?i)\bv?\d+(?:\.\d+)*(?:-[\w.]+)?\b'), regexp_extract_all(c, '(?i)\bmarch\s+\d{{1,2}},\s+\d{{4}}\b')), lambda a: lower(a))) AS a FROM v),
s AS (SELECT *, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / least(len(x), len(y))::DOUBLE END AS lex, list_filter(a, lambda w: NOT contains(lower(e), w)) AS gone FROM t)"""


@query(f"WITH {EVIDENCE} SELECT item_id, round(CASE WHEN len(a) = 0 THEN lex ELSE least(lex, (len(a) - len(gone)) / len(a)::DOUBLE) END, 6) AS score, array_to_string(list_sort(gone), ';') AS missing, array_to_string(list_sort(list_intersect(x, y))[1:12], ',') AS matched FROM s")
def al13_alignment(m: Model) -> DataFrame:
    a = research.aligned(_evidence(m), F.col("claim"), F.col("evidence"))
    return a.select("item_id", F.round("score", 6).alias("score"), F.array_join(F.array_sort("missing"), ";").alias("missing"), F.array_join("matched", ",").alias("matched"))


@query(f"""WITH {EVIDENCE}, d AS (SELECT *, CASE item_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'not there' ELSE 'version' END AS span, CASE WHEN item_id % 11 > 0 THEN e END AS passage, item_id % 13 > 0 AS known FROM s)
SELECT item_id, CASE WHEN span = '' THEN 'empty_span' WHEN passage IS NULL THEN 'unknown_passage' WHEN NOT contains(passage, span) THEN 'span_not_verbatim' WHEN NOT known THEN 'unknown_sub_question' WHEN CASE WHEN len(a) = 0 THEN lex ELSE least(lex, (len(a) - len(gone)) / len(a)::DOUBLE) END = 0 THEN 'not_aligned' WHEN len(gone) > 0 THEN 'missing_anchors' END AS reason,
 CASE WHEN span <> '' AND contains(passage, span) THEN strpos(passage, span) - 1 END AS start FROM d""")
def al14_draft_verdicts(m: Model) -> DataFrame:
    n = F.col("item_id")
    a = research.aligned(_evidence(m), F.col("claim"), F.col("evidence"))
    span, passage = pick(n, "", "not there", "version", "version", "version", "version", "version"), F.when(n % 11 > 0, F.col("evidence"))
    found = F.when((span != "") & passage.contains(span), F.instr(passage, "version") - 1)
    return a.select("item_id", research.draft_verdict(span, passage, n % 13 > 0, F.col("score"), F.size("missing")).alias("reason"), found.cast("long").alias("start"))


@query("""WITH r AS (SELECT l_orderkey AS source_id, l_linenumber AS n, l_discount AS c, l_partkey AS p, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey % 100 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem)
SELECT source_id % 100 AS source, source_id, n, CASE WHEN c * 10 > 0.8 THEN 'certain' WHEN c * 10 > 0.5 THEN 'likely' ELSE 'uncertain' END AS hedge FROM r WHERE place <= 12""")
def al15_drafted_findings(m: Model) -> DataFrame:
    rows = m.lineitem.select((F.col("l_orderkey") % 100).alias("source"), F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("n"), "l_partkey", "l_suppkey", (F.col("l_discount") * 10).alias("confidence"))
    return research.drafted_findings(rows, "source", ["source_id", "n", "l_partkey", "l_suppkey"]).select("source", "source_id", "n", "hedge")


@query("SELECT doc_id, md5(CASE WHEN len(text) > 16000 THEN text[1:16000] ELSE text END) AS head FROM documents WHERE text IS NOT NULL")
def al16_first_passages(m: Model) -> DataFrame:
    return m.documents.where("text is not null").select("doc_id", F.md5(research.first_passage(F.col("text")).cast("binary")).alias("head"))


# --- cases for evaluation ---


@query("""WITH c AS (SELECT p_partkey % 900 AS id, CASE p_partkey % 4 WHEN 0 THEN 'same_claim' WHEN 1 THEN 'new_claim' WHEN 2 THEN 'contradiction' ELSE 'supersedes' END AS expected, CASE WHEN p_partkey % 4 <> 1 AND p_partkey % 10 > 0 THEN 'm' END AS matched, CASE WHEN p_partkey % 31 = 0 THEN ' ' ELSE 'why' END AS rationale, 1 + CAST(p_partkey % 50 = 7 AS INT) AS version FROM part)
SELECT 'duplicate id' AS problem, CAST(id AS STRING) AS id FROM c GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'no rationale', CAST(id AS STRING) FROM c WHERE trim(rationale) = '' UNION ALL SELECT 'unknown version', CAST(id AS STRING) FROM c WHERE version <> 1
UNION ALL SELECT 'match', CAST(id AS STRING) FROM c WHERE (expected = 'new_claim') = (matched IS NOT NULL) UNION ALL SELECT 'too few', l FROM (SELECT unnest(['same_claim', 'near_duplicate', 'elaboration', 'qualification', 'contradiction', 'supersedes', 'new_claim']) AS l) WHERE (SELECT count(*) FROM c WHERE expected = l) < 6""")
def ev01_corpus_problems(m: Model) -> DataFrame:
    n = F.col("p_partkey")
    cases = m.part.select((n % 900).alias("id"), pick(n, "same_claim", "new_claim", "contradiction", "supersedes").alias("expected"), F.when((n % 4 != 1) & (n % 10 > 0), F.lit("m")).alias("matched"), F.when(n % 31 == 0, F.lit(" ")).otherwise(F.lit("why")).alias("rationale"), F.when(n % 50 == 7, 2).otherwise(1).alias("version"))
    return evaluate.corpus_problems(cases)


@query()
def ev02_cases(m: Model) -> DataFrame:
    """Each part as an observation against one claim that is made from it by a known change; tested for each change."""
    rows = _assertions(m).withColumn("family_id", F.col("id").cast("string"))
    n = F.col("id")
    claim = rows.withColumn("polarity", F.when(n % 5 == 1, F.when(F.col("polarity") == "negative", F.lit("positive")).otherwise(F.lit("negative"))).otherwise(F.col("polarity"))).withColumn("subject", F.when(n % 5 == 2, F.lit("something else entirely")).otherwise(F.col("subject")))
    return evaluate.cases(rows, claim, reconcile.plan_batch)


# --- named reads and runs through the facade ---


def _knowledge(m: Model) -> Knowledge:
    log = m.glog
    claims = knowledge.accepted_claims(log).withColumns({"last_seen_at": F.col("observed_at"), "expired_at": F.lit(None).cast("string"), "curation_status": F.lit("active"), "thread_id": F.lit(None).cast("string")})
    views = {"families": knowledge.families(log), "threads": knowledge.threads(log), "claims": claims, "evidence": knowledge.stances(log), "contradictions": knowledge.contradictions(log), "gaps": knowledge.gaps(log), "entities": knowledge.entities(log)}
    return Knowledge(views, log)


@query(f"""WITH {MOVES}, c AS (SELECT {j('threadId')} AS id, min(seq) AS pos, arg_min({j('familyId')}, seq) AS fam, arg_min({j('label')}, seq) AS label FROM glog WHERE {k('THREAD_CREATED')} GROUP BY 1), d AS (SELECT {j('threadId')} AS id, max(seq) AS done FROM glog WHERE {k('THREAD_RESOLVED')} GROUP BY 1)
SELECT c.id, coalesce(ends.t, fam) AS family_id, label, CASE WHEN done > pos THEN 'resolved' ELSE 'open' END AS status FROM c LEFT JOIN ends ON ends.id = fam LEFT JOIN d ON d.id = c.id WHERE coalesce(ends.t, fam) IN ('f5', 'f7', 'f11')""")
def q_graph_threads(m: Model) -> DataFrame:
    return _knowledge(m).ask("threads", family_id=["f5", "f7", "f11"])


@query(f"""WITH b AS (SELECT {j('id')} AS id, max(seq) AS pos, arg_max({j('familyId')}, seq) AS family_id FROM glog WHERE {k('CONTRADICTION_IDENTIFIED')} GROUP BY 1), r AS (SELECT b.id, arg_max({j('newStatus')}, seq) AS status FROM glog JOIN b ON b.id = {j('contradictionId')} AND seq > pos WHERE {k('CONTRADICTION_RESOLVED')} GROUP BY 1)
SELECT b.id, coalesce(status, 'unresolved') AS status FROM b LEFT JOIN r ON r.id = b.id WHERE family_id = 'f4'""")
def q_graph_contradictions(m: Model) -> DataFrame:
    return _knowledge(m).ask("contradictions", family_id="f4").select("id", "status")


@query(f"""SELECT id, priority FROM (SELECT {j('id')} AS id, arg_max({j('familyId')}, seq) AS fam, arg_max(CAST({j('priority')} AS INT), seq) AS priority FROM glog WHERE {k('GAP_OPENED')} GROUP BY 1) WHERE fam = 'f3'""")
def q_graph_gaps(m: Model) -> DataFrame:
    return _knowledge(m).ask("gaps", family_id="f3").select("id", "priority")


@query(f"""WITH a AS (SELECT {j('id')} AS id, max(seq) AS pos, arg_max({j('label')}, seq) AS label FROM glog WHERE {k('NODE_ADDED')} GROUP BY 1), r AS (SELECT a.id, arg_max({j('newLabel')}, seq) AS label FROM glog JOIN a ON a.id = {j('targetId')} AND seq > pos WHERE {k('NODE_RELABELED')} GROUP BY 1),
g AS (SELECT id, max(seq) AS gone FROM (SELECT seq, unnest(CAST(json_extract(payload, '$.mergedIds') AS VARCHAR[])) AS id FROM glog WHERE {k('ENTITY_MERGED')} UNION ALL SELECT seq, {j('originalId')} FROM glog WHERE {k('ENTITY_SPLIT')}) GROUP BY 1)
SELECT a.id FROM a LEFT JOIN r ON r.id = a.id LEFT JOIN g ON g.id = a.id WHERE (gone IS NULL OR gone < pos) AND lower(coalesce(r.label, a.label)) = 'brand#13'""")
def q_graph_entity(m: Model) -> DataFrame:
    return _knowledge(m).ask("entity", label="BRAND#13").select("id")


@query(f"""SELECT seq, event_type FROM glog WHERE seq > 2000 AND (coalesce({j('familyId')}, {j('family_id')}) = 'f5' OR (SELECT count(*) FROM (SELECT {j('id').replace('payload', 'g2.payload')} AS c, arg_max({j('familyId').replace('payload', 'g2.payload')}, g2.seq) AS f FROM glog g2 WHERE g2.event_type = 'CLAIM_ACCEPTED' GROUP BY 1) x WHERE x.f = 'f5' AND x.c IN ({", ".join(j(n) for n in ('claimId', 'claimIdA', 'claimIdB', 'sourceClaimId', 'fromClaimId', 'toClaimId', 'reconciliation.canonicalClaimId'))})) > 0) ORDER BY seq LIMIT 40""")
def api_changes_of_family(m: Model) -> DataFrame:
    return _knowledge(m).ask("changes", since=2000, family_id="f5", limit=40).select("seq", "event_type")


@query(f"SELECT seq, event_type FROM glog WHERE {j('gapId')} = 'g9' ORDER BY seq")
def api_timeline_of_gap(m: Model) -> DataFrame:
    return _knowledge(m).ask("timeline", gap_id="g9").select("seq", "event_type")


def _runs(m: Model) -> Runs:
    return Runs(m.log.withColumn("payload", F.to_json(F.struct(F.col("run_id").cast("string").alias("runId"), F.lit("hidden").alias("lease"), F.col("value").alias("percent")))))


@query("""WITH q AS (SELECT run_id, min(seq) AS seq, min(family_id) AS family_id, arg_max(event_type, seq) AS last FROM log GROUP BY 1) SELECT * FROM q WHERE family_id = 3 ORDER BY seq DESC LIMIT 50""")
def r_list_of_family(m: Model) -> DataFrame:
    return _runs(m).list(family_id=3)


@query("SELECT seq, event_type, CASE WHEN event_type IN ('RUN_COMPLETED', 'RUN_FAILED', 'RUN_RUNNING', 'RUN_QUEUED') THEN '{\"runId\":\"3\"}' END AS shown FROM log WHERE run_id = 3")
def r_history(m: Model) -> DataFrame:
    return _runs(m).history(3).select("seq", "event_type", F.when(F.col("event_type") != "RUN_PROGRESS", F.col("payload")).alias("shown"))


@query("WITH e AS (SELECT min(seq) AS stop FROM log WHERE run_id = 5 AND event_type IN ('RUN_COMPLETED', 'RUN_FAILED')) SELECT seq, event_type FROM log, e WHERE run_id = 5 AND seq > 10 AND (stop IS NULL OR seq <= stop) ORDER BY seq LIMIT 100")
def r_event_feed(m: Model) -> DataFrame:
    return _runs(m).events(5, after=10).select("seq", "event_type")
