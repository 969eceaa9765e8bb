"""Scans, filters, pages, drill-downs, search and longitudinal queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.addresses import authority_rank
from ..operators import graph, longitudinal, readmodel, search
from .model import Model
from .registry import query

CLAIM = ["id", "family_id", "last_seen_at", "epistemic_status"]


@query("SELECT event_id AS seq, user_id, event_type FROM events WHERE event_id > 100")
def src01_scan_after(m: Model) -> DataFrame:
    return m.events.where("event_id > 100").select(F.col("event_id").alias("seq"), "user_id", "event_type")


@query("SELECT seq, run_id, event_type FROM log WHERE event_type = 'RUN_FAILED' AND run_id < 50 AND ts >= TIMESTAMP '2024-01-10 00:00:00' ORDER BY seq LIMIT 40")
def src02_filtered_scan(m: Model) -> DataFrame:
    rows = m.log.where((F.col("event_type") == "RUN_FAILED") & (F.col("run_id") < 50) & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")))
    return rows.select("seq", "run_id", "event_type").orderBy("seq").limit(40)


@query("SELECT CAST(max(seq) AS BIGINT) AS latest, count(*) AS events FROM log")
def src03_latest_cursor(m: Model) -> DataFrame:
    return m.log.agg(F.max("seq").cast("long").alias("latest"), F.count("*").alias("events"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def src04_decode_payload(m: Model) -> DataFrame:
    return m.events.select("event_id", F.expr("try_variant_get(parse_json(props), '$.k', 'bigint')").alias("k"))


@query("""SELECT 'claims' AS name, count(*) AS n FROM claims UNION ALL SELECT 'evidence', count(*) FROM evidence UNION ALL SELECT 'sources', count(*) FROM sources UNION ALL SELECT 'families', count(*) FROM families""")
def src05_read_model_scan(m: Model) -> DataFrame:
    out = None
    for name in ("claims", "evidence", "sources", "families"):
        one = getattr(m, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT 1 AS version, CAST(max(seq) AS BIGINT) AS last_applied_seq, CASE WHEN max(seq) >= count(*) - 1 THEN 'ready' ELSE 'dirty' END AS status FROM log")
def src06_status_row(m: Model) -> DataFrame:
    return m.log.agg(F.max("seq").alias("latest"), F.count("*").alias("n")).select(
        F.lit(1).alias("version"), F.col("latest").cast("long").alias("last_applied_seq"), F.when(F.col("latest") >= F.col("n") - 1, F.lit("ready")).otherwise(F.lit("dirty")).alias("status")
    )


@query("SELECT id, family_id, last_seen_at, epistemic_status FROM claims WHERE expired_at IS NULL")
def flt01_active_claims(m: Model) -> DataFrame:
    return readmodel.active(m.claims).select(*CLAIM)


@query("SELECT id, family_id, last_seen_at, epistemic_status FROM claims WHERE epistemic_status = 'contested' AND polarity = 'O'")
def flt02_equality_filters(m: Model) -> DataFrame:
    return readmodel.filtered(m.claims, epistemic_status="contested", polarity="O", family_id=None).select(*CLAIM)


RELATIONS = "relations AS (SELECT l_orderkey AS from_id, l_partkey AS to_id, count(*) AS weight FROM lineitem GROUP BY l_orderkey, l_partkey)"


def relations(m: Model) -> DataFrame:
    return m.lineitem.groupBy(F.col("l_orderkey").alias("from_id"), F.col("l_partkey").alias("to_id")).agg(F.count("*").alias("weight"))


@query(f"WITH {RELATIONS} SELECT from_id, to_id, weight FROM relations WHERE from_id = 7 OR to_id = 7")
def flt03_relations_either(m: Model) -> DataFrame:
    return readmodel.related(relations(m), 7)


@query(f"WITH {RELATIONS} SELECT from_id, to_id, weight FROM relations WHERE to_id = 7")
def flt03_relations_to(m: Model) -> DataFrame:
    return readmodel.related(relations(m), 7, "to")


@query("SELECT id, curation_status FROM claims WHERE coalesce(curation_status, 'active') = 'active'")
def flt05_curated(m: Model) -> DataFrame:
    return m.claims.where(readmodel.curated(F.col("curation_status"))).select("id", "curation_status")


@query("SELECT e.id, e.claim_id FROM evidence e LEFT JOIN claims c ON e.claim_id = c.id WHERE c.id IS NULL OR c.curation_status <> 'merged'")
def flt06_active_evidence(m: Model) -> DataFrame:
    c = m.claims.select(F.col("id").alias("claim"), "curation_status")
    e = m.evidence.select("id", "claim_id")
    return e.join(c, e["claim_id"] == c["claim"], "left").where("claim is null or curation_status <> 'merged'").select("id", "claim_id")


@query("SELECT id, domain, quality FROM sources WHERE extraction_status <> 'failed' AND quality >= 100")
def flt09_usable_sources(m: Model) -> DataFrame:
    return m.sources.where((F.col("extraction_status") != "failed") & (F.col("quality") >= 100)).select("id", "domain", "quality")


FIRST = "SELECT id, family_id, last_seen_at, epistemic_status FROM claims WHERE expired_at IS NULL ORDER BY last_seen_at DESC NULLS LAST, id LIMIT 50"


@query(FIRST)
def pg01_claims_page1(m: Model) -> DataFrame:
    return readmodel.page(readmodel.active(m.claims)).select(*CLAIM)


@query(f"""WITH p AS ({FIRST}), k AS (SELECT last_seen_at AS t, id AS i FROM p ORDER BY last_seen_at, id DESC LIMIT 1)
SELECT id, family_id, last_seen_at, epistemic_status FROM claims, k WHERE expired_at IS NULL AND (last_seen_at < t OR last_seen_at IS NULL OR (last_seen_at = t AND id > i))
ORDER BY last_seen_at DESC NULLS LAST, id LIMIT 50""")
def pg01_claims_page2(m: Model) -> DataFrame:
    rows = readmodel.active(m.claims)
    last = readmodel.page(rows).orderBy(F.col("last_seen_at").asc_nulls_first(), F.col("id").desc()).first()  # one row of a page
    cursor = readmodel.decode_cursor("claims", 2, readmodel.encode_cursor("claims", [last["last_seen_at"], last["id"]])) if last else None
    return readmodel.page(rows, cursor=cursor).select(*CLAIM)


@query("SELECT id, claim_id, stance FROM evidence WHERE claim_id = 35 AND stance = 'supports' ORDER BY id LIMIT 100")
def q_evidence_of_claim(m: Model) -> DataFrame:
    return readmodel.filtered(m.evidence, claim_id=35, stance="supports").select("id", "claim_id", "stance").orderBy("id").limit(readmodel.page_limit(500))


@query("SELECT id, family_id, last_seen_at, epistemic_status FROM claims WHERE id = 5")
def q_claim_by_id(m: Model) -> DataFrame:
    return readmodel.filtered(m.claims, id=5).select(*CLAIM)


@query("SELECT id, title, domain, authority_class FROM sources WHERE extraction_status = 'extracted' ORDER BY id LIMIT 50")
def q_sources(m: Model) -> DataFrame:
    return readmodel.filtered(m.sources, extraction_status="extracted").select("id", "title", "domain", "authority_class").orderBy("id").limit(50)


TOKENS = r"""tok AS (SELECT p_partkey AS key, CAST(pos - 1 AS INT) AS pos, list_element(w, pos) AS token FROM (
  SELECT p_partkey, w, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT p_partkey, string_split(trim(regexp_replace(regexp_replace(lower(p_name || ' ' || p_type), '[^\p{L}\p{N}\s]+', ' ', 'g'), '\s+', ' ', 'g')), ' ') AS w FROM part)))"""


def _index(m: Model) -> DataFrame:
    return readmodel.token_index(m.part.withColumn("name", F.concat_ws(" ", "p_name", "p_type")), "p_partkey", ["name"])


@query(f"WITH {TOKENS} SELECT DISTINCT a.key FROM tok a JOIN tok b ON a.key = b.key WHERE a.token = 'red' AND b.token LIKE 's%'")
def ft01_all_terms(m: Model) -> DataFrame:
    return readmodel.matching(_index(m), "red s*")


@query(f"WITH {TOKENS} SELECT DISTINCT key FROM tok WHERE token LIKE 'st%' AND key NOT IN (SELECT key FROM tok WHERE token = 'red')")
def ft01_not(m: Model) -> DataFrame:
    return readmodel.matching(_index(m), "st* NOT red")


@query("SELECT p_partkey AS key FROM part WHERE lower(p_name) || ' ' || lower(p_type) LIKE '% ' || (SELECT lower(min(p_type)) FROM part) OR lower(p_type) = (SELECT lower(min(p_type)) FROM part)")
def ft01_phrase(m: Model) -> DataFrame:
    phrase = m.part.agg(F.lower(F.min("p_type"))).first()[0]  # one value
    return readmodel.matching(_index(m), f'"{phrase}"')


@query(f"WITH {TOKENS} SELECT DISTINCT CAST(a.key AS STRING) AS key FROM tok a JOIN tok b ON a.key = b.key WHERE a.token = 'red' AND b.token LIKE 's%'")
def ft01_stored_index(m: Model) -> DataFrame:
    """The same search in an index that is built once and opened by word."""
    index = search.SearchIndex(m.spark, f"{graph.shared_folder(m.spark)}/mossgraph/{uuid.uuid4().hex}")
    index.update(m.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("name")), "p_partkey", ["name"])
    return index.search("réd s*")


@query("""SELECT l.seq, l.run_id, l.event_type FROM log l JOIN (SELECT DISTINCT run_id FROM log WHERE event_type = 'RUN_FAILED') f ON l.run_id = f.run_id WHERE l.event_type = 'RUN_QUEUED'""")
def jn01_events_of_failed_runs(m: Model) -> DataFrame:
    log = m.log
    failed = log.where("event_type = 'RUN_FAILED'").select("run_id")
    return log.where("event_type = 'RUN_QUEUED'").join(failed, "run_id", "left_semi").select("seq", "run_id", "event_type")


@query("""SELECT c.id AS claim_id, e.id AS evidence_id, e.source_id, e.stance, s.domain, s.authority_class FROM claims c LEFT JOIN evidence e ON c.id = e.claim_id LEFT JOIN sources s ON e.source_id = s.id""")
def jn04_provenance_chains(m: Model) -> DataFrame:
    return longitudinal.provenance(m.claims, m.evidence, m.sources).select("claim_id", "evidence_id", "source_id", "stance", "domain", "authority_class")


CHAINS = """ob AS (SELECT id, claim_id FROM evidence WHERE seq_in_claim % 2 = 1), ev AS (SELECT id, claim_id, source_id, stance, CASE WHEN subject_id % 5 = 0 THEN NULL WHEN subject_id % 7 = 0 THEN 'lost' ELSE id END AS observation_id FROM evidence WHERE subject_id % 3 > 0)"""


@query(f"""WITH {CHAINS} SELECT coalesce(ob.claim_id, ev.claim_id) AS claim_id, coalesce(ob.id, ev.observation_id) AS observation_id, ev.id AS evidence_id, ev.source_id, ev.stance, s.domain,
 CASE WHEN ev.id IS NULL THEN 'bare' WHEN ob.id IS NOT NULL THEN 'attributed' WHEN ev.observation_id IS NULL THEN 'unattributed' ELSE 'orphan' END AS part
FROM ob FULL JOIN ev ON ob.claim_id = ev.claim_id AND ob.id = ev.observation_id LEFT JOIN sources s ON s.id = ev.source_id""")
def jn04_chains_with_orphans(m: Model) -> DataFrame:
    """Observations with their evidence or without, and evidence of none or of one that is not the claim's."""
    k = F.col("subject_id")
    observations = m.evidence.where("seq_in_claim % 2 = 1").select("id", "claim_id")
    evidence = m.evidence.where(k % 3 > 0).withColumn("observation_id", F.when(k % 5 == 0, F.lit(None)).when(k % 7 == 0, F.lit("lost")).otherwise(F.col("id")))
    return longitudinal.provenance_chains(observations, evidence, m.sources)


@query("SELECT DISTINCT e.source_id, c.family_id FROM evidence e JOIN claims c ON e.claim_id = c.id")
def jn05_source_families(m: Model) -> DataFrame:
    c = m.claims.select(F.col("id").alias("claim_id"), "family_id")
    return m.evidence.select("claim_id", "source_id").join(c, "claim_id").select("source_id", "family_id").distinct()


@query("SELECT l.seq, l.event_type FROM log l WHERE EXISTS (SELECT 1 FROM families f WHERE f.id = l.family_id AND f.scope = 'BUILDING')")
def jn07_events_of_families(m: Model) -> DataFrame:
    f = m.families.where("scope = 'BUILDING'").select(F.col("id").alias("family_id"))
    return m.log.join(f, "family_id", "left_semi").select("seq", "event_type")


@query("SELECT id, label FROM families f WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE c.family_id = f.id AND c.curation_status = 'merged')")
def jn08_families_untried(m: Model) -> DataFrame:
    """Families that no curator has merged claims of."""
    return m.families.join(m.claims.where("curation_status = 'merged'").select(F.col("family_id").alias("id")), "id", "left_anti").select("id", "label")


@query("SELECT id FROM sources s WHERE NOT EXISTS (SELECT 1 FROM evidence e WHERE e.source_id = s.id AND e.stance = 'supports' AND e.observed_at >= '2001-10-25')")
def jn09_sources_without_findings(m: Model) -> DataFrame:
    used = m.evidence.where("stance = 'supports' and observed_at >= '2001-10-25'").select(F.col("source_id").alias("id"))
    return m.sources.join(used, "id", "left_anti").select("id")


@query("SELECT id, label FROM families WHERE lower(label) = lower('CUSTOMER#000000005') OR id = (SELECT min(id) FROM families WHERE lower(scope) = lower('building'))")
def jn21_by_label(m: Model) -> DataFrame:
    f = m.families
    first = f.where(F.lower("scope") == "building").agg(F.min("id").alias("id"))
    return f.where(F.lower("label") == F.lower(F.lit("CUSTOMER#000000005"))).select("id", "label").union(f.join(first, "id", "left_semi").select("id", "label")).distinct()


BELIEF = """WITH r AS (SELECT e.*, s.domain, s.authority_class, CASE s.authority_class WHEN 'official_spec' THEN 0 WHEN 'official_changelog' THEN 1 WHEN 'official_repo' THEN 2 WHEN 'vendor_docs' THEN 3
 WHEN 'package_registry' THEN 4 WHEN 'vendor_sdk_docs' THEN 5 WHEN 'third_party_analysis' THEN 6 WHEN 'news' THEN 7 WHEN 'encyclopedia' THEN 8 WHEN 'forum_social' THEN 9 ELSE 11 END AS rk
 FROM evidence e LEFT JOIN sources s ON e.source_id = s.id), g AS (SELECT claim_id, count(*) FILTER (WHERE stance = 'supports') AS n_supports, count(*) FILTER (WHERE stance = 'opposes') AS n_opposes,
 count(*) FILTER (WHERE stance = 'context') AS n_context, count(DISTINCT domain) AS n_domains FROM r GROUP BY claim_id),
 b AS (SELECT *, row_number() OVER (PARTITION BY claim_id, stance ORDER BY rk, seq_in_claim, id, source_id) AS n FROM r)
SELECT c.id AS claim_id, c.family_id, c.epistemic_status, coalesce(n_supports, 0) AS n_supports, coalesce(n_opposes, 0) AS n_opposes, coalesce(n_context, 0) AS n_context, coalesce(n_domains, 0) AS n_domains,
 s.source_id AS strongest_support, s.authority_class AS support_class, o.source_id AS strongest_oppose
FROM claims c LEFT JOIN g ON c.id = g.claim_id LEFT JOIN b s ON s.claim_id = c.id AND s.stance = 'supports' AND s.n = 1 LEFT JOIN b o ON o.claim_id = c.id AND o.stance = 'opposes' AND o.n = 1"""


@query(BELIEF)
def belief_view(m: Model) -> DataFrame:
    return longitudinal.belief_view(m.claims, m.evidence, m.sources)


DESCRIBE = "CASE event_type WHEN 'RUN_QUEUED' THEN 'Run queued' WHEN 'RUN_RUNNING' THEN 'Run is running' WHEN 'RUN_COMPLETED' THEN 'Run completed with ' || CAST(CAST(floor(value) AS BIGINT) AS STRING) WHEN 'RUN_FAILED' THEN 'Run failed' ELSE event_type END"


@query(f"SELECT seq, event_type, {DESCRIBE} AS description FROM log WHERE run_id = 3 OR (family_id = 4 AND event_type = 'RUN_COMPLETED')")
def l_timeline_union(m: Model) -> DataFrame:
    rows = m.log.withColumn("description", longitudinal.described(F.col("event_type"), F.col("value"))).select("seq", "event_type", "description", "run_id", "family_id")
    keep = ["seq", "event_type", "description"]
    return longitudinal.timeline(rows.where("run_id = 3").select(*keep), rows.where("family_id = 4 and event_type = 'RUN_COMPLETED'").select(*keep))


@query("SELECT seq, event_type FROM (SELECT * FROM log WHERE seq > 50 ORDER BY seq LIMIT 30) WHERE event_type IN ('RUN_COMPLETED', 'RUN_FAILED') ORDER BY seq LIMIT 30")
def l_changes_all(m: Model) -> DataFrame:
    return longitudinal.change_feed(m.log, 50, 30, ["RUN_COMPLETED", "RUN_FAILED"]).select("seq", "event_type")


@query("SELECT seq, event_type FROM (SELECT * FROM log WHERE seq > 50 AND family_id = 3 ORDER BY seq LIMIT 200) WHERE event_type IN ('RUN_COMPLETED', 'RUN_FAILED') ORDER BY seq LIMIT 30")
def l_changes_of_family(m: Model) -> DataFrame:
    return longitudinal.change_feed(m.log, 50, 30, ["RUN_COMPLETED", "RUN_FAILED"], family=3).select("seq", "event_type")


@query("""WITH t AS (SELECT 'gap' AS type, CAST(id AS STRING) AS id, CAST(1 + id % 4 - CASE WHEN id % 3 = 0 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score FROM claims WHERE epistemic_status = 'unknown'
UNION ALL SELECT 'contradiction', CAST(id AS STRING), CAST(2.0 AS DOUBLE) FROM claims WHERE epistemic_status = 'contested' AND expired_at IS NULL)
SELECT type, id, score, row_number() OVER (PARTITION BY type ORDER BY score, id) AS place FROM t""")
def l_next_targets(m: Model) -> DataFrame:
    c = m.claims
    gaps = c.where("epistemic_status = 'unknown'").select("id", F.lit("open").alias("status"), F.lit("why").alias("question"), (1 + F.col("id") % 4).cast("double").alias("priority"), (F.col("id") % 3 == 0).alias("single_source"))
    bad = readmodel.active(c).where("epistemic_status = 'contested'").select("id", F.lit("unresolved").alias("resolution_status"))
    return longitudinal.research_targets(gaps, bad)


@query("""WITH x AS (SELECT user_id % 97 AS source, event_id AS seq, CASE WHEN event_type = 'error' THEN 'SOURCE_CHANGED' ELSE 'SOURCE_OBSERVED' END AS event_type FROM events WHERE event_type IN ('error', 'view')),
y AS (SELECT *, coalesce(lag(event_type) OVER (PARTITION BY source ORDER BY seq) = 'SOURCE_CHANGED', false) AS changed FROM x) SELECT source, seq, changed FROM y WHERE event_type <> 'SOURCE_CHANGED'""")
def sh01_source_history(m: Model) -> DataFrame:
    rows = m.events.where(F.col("event_type").isin("error", "view")).select(
        (F.col("user_id") % 97).alias("source"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", F.lit("SOURCE_CHANGED")).otherwise(F.lit("SOURCE_OBSERVED")).alias("event_type")
    )
    return longitudinal.source_history(rows).select("source", "seq", "changed")


@query("""WITH s AS (SELECT c.family_id, count(DISTINCT e.source_id) AS n_sources FROM claims c JOIN evidence e ON e.claim_id = c.id GROUP BY 1),
c2 AS (SELECT family_id, count(*) AS n_claims, count(*) FILTER (WHERE expired_at IS NULL) AS n_active, count(*) FILTER (WHERE epistemic_status = 'contested') AS n_contested, max(last_seen_at) AS last_activity FROM claims GROUP BY 1)
SELECT f.id AS family_id, f.label, coalesce(n_claims, 0) AS n_claims, coalesce(n_active, 0) AS n_active, coalesce(n_contested, 0) AS n_contested, coalesce(n_sources, 0) AS n_sources, last_activity,
 f.label || ': ' || CAST(coalesce(n_active, 0) AS STRING) || ' of ' || CAST(coalesce(n_claims, 0) AS STRING) || ' claims active' AS narrative
FROM families f LEFT JOIN c2 ON f.id = c2.family_id LEFT JOIN s ON f.id = s.family_id""")
def l_family_dashboard(m: Model) -> DataFrame:
    return longitudinal.family_dashboard(m.families, m.claims, m.evidence)


@query("SELECT id, authority_class, CAST(nation % 11 AS INT) AS authority_rank FROM sources WHERE nation % 11 < 10")
def fn25_authority_rank(m: Model) -> DataFrame:
    return m.sources.where("nation % 11 < 10").select("id", "authority_class", authority_rank(F.col("authority_class")).cast("int").alias("authority_rank"))


@query("SELECT id, family_id, place FROM (SELECT id, family_id, row_number() OVER (PARTITION BY family_id ORDER BY value DESC, id) AS place FROM claims) WHERE place <= 5")
def wn01_top_claims(m: Model) -> DataFrame:
    w = Window.partitionBy("family_id").orderBy(F.col("value").desc(), "id")
    return m.claims.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 5").select("id", "family_id", "place")
