"""The driver's tables as knowledge tables, in SQL that both engines read alike.

Orders are claims, line items evidence, suppliers sources, customers families and the events of users the life of runs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUTHORITY_SQL = "CASE s_nationkey % 11 " + " ".join(
    f"WHEN {k} THEN '{name}'" for k, name in enumerate(("official_spec", "official_changelog", "official_repo", "vendor_docs", "package_registry", "vendor_sdk_docs", "third_party_analysis", "news", "encyclopedia", "forum_social"))
) + " END"

VIEWS: dict[str, str] = {
    "families": "SELECT c_custkey AS id, c_name AS label, c_mktsegment AS scope, c_nationkey AS nation FROM customer",
    "claims": """SELECT o_orderkey AS id, o_custkey AS family_id, CAST(CAST(o_orderdate AS DATE) AS STRING) AS last_seen_at,
        CASE WHEN o_orderstatus = 'F' THEN CAST(CAST(o_orderdate AS DATE) AS STRING) END AS expired_at,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'consensus' WHEN '2' THEN 'emerging' WHEN '3' THEN 'contested' WHEN '4' THEN 'speculative' ELSE 'unknown' END AS epistemic_status,
        CASE WHEN o_orderstatus = 'P' THEN 'merged' ELSE 'active' END AS curation_status, o_orderstatus AS polarity, o_totalprice AS value FROM orders""",
    "evidence": """SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(CAST(round(l_extendedprice * 100, 0) AS BIGINT) AS STRING)) AS id,
        l_orderkey AS claim_id, l_suppkey AS source_id, l_partkey AS subject_id, l_linenumber AS seq_in_claim,
        CASE l_returnflag WHEN 'A' THEN 'supports' WHEN 'R' THEN 'opposes' ELSE 'context' END AS stance,
        CAST(CAST(l_shipdate AS DATE) AS STRING) AS observed_at, l_discount AS confidence,
        CASE CAST(l_quantity AS INT) % 5 WHEN 0 THEN 'study' WHEN 1 THEN 'benchmark' WHEN 2 THEN 'claim' WHEN 3 THEN 'opinion' ELSE 'anecdote' END AS evidence_type FROM lineitem""",
    "sources": f"""SELECT s_suppkey AS id, s_name AS title, lower(n_name) || '.example' AS domain, {AUTHORITY_SQL} AS authority_class, s_nationkey AS nation,
        CASE WHEN s_acctbal < 0 THEN 'failed' WHEN s_acctbal < 2000 THEN 'partial' ELSE 'extracted' END AS extraction_status, s_acctbal AS quality
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "log": """SELECT event_id AS seq, CAST(user_id AS BIGINT) AS run_id, user_id % 10 AS family_id, ts,
        CASE event_type WHEN 'view' THEN 'RUN_PROGRESS' WHEN 'signup' THEN 'RUN_QUEUED' WHEN 'click' THEN 'RUN_RUNNING' WHEN 'purchase' THEN 'RUN_COMPLETED' ELSE 'RUN_FAILED' END AS event_type,
        value, props FROM events""",
}
VIEWS["klog"] = """SELECT o_orderkey * 10 AS seq, 'r' || CAST(o_custkey % 50 AS STRING) AS run_id, 'CLAIM_OBSERVED' AS event_type, '{"claimId":"c' || CAST(o_orderkey % 700 AS STRING) || '","familyId":"f' || CAST(o_custkey % 20 AS STRING)
  || '","subject":"s' || CAST(o_orderkey AS STRING) || '","observedAt":"' || CAST(CAST(o_orderdate AS DATE) AS STRING) || '"}' AS payload FROM orders
UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'r' || CAST(min(l_suppkey) % 50 AS STRING), 'EVIDENCE_LINKED', '{"id":"e' || CAST(l_orderkey % 900 AS STRING) || '-' || CAST(l_linenumber AS STRING) || '","claimId":"c' || CAST(l_orderkey % 700 AS STRING)
  || '","stance":"' || CASE min(l_returnflag) WHEN 'A' THEN 'supports' WHEN 'R' THEN 'opposes' ELSE 'context' END || '"}' FROM lineitem GROUP BY l_orderkey, l_linenumber
UNION ALL SELECT o_orderkey * 10 + 8, 'r1', 'CLAIM_MERGED', '{"claimId":"c' || CAST(o_orderkey AS STRING) || '","intoClaimId":"c' || CAST(o_orderkey + 1 AS STRING) || '"}' FROM orders WHERE o_orderkey % 97 IN (5, 6, 7, 40)
UNION ALL SELECT o_orderkey * 10 + 9, 'r' || CAST(o_custkey % 50 AS STRING), 'CLAIM_EXPIRED', '{"claimId":"c' || CAST(o_orderkey % 700 AS STRING) || '","expiredAt":"2024-01-0' || CAST(o_orderkey % 9 + 1 AS STRING) || '"}' FROM orders WHERE o_orderkey % 31 = 3
UNION ALL SELECT 1000000000000000 + event_id, 'r' || CAST(user_id % 50 AS STRING), CASE event_type WHEN 'view' THEN 'SOURCE_OBSERVED' WHEN 'click' THEN 'SOURCE_READ' WHEN 'error' THEN 'SOURCE_RETRACTED' WHEN 'signup' THEN 'EDGE_ADDED' ELSE 'EDGE_REMOVED' END,
  CASE event_type WHEN 'view' THEN '{"sourceId":"s' || CAST(user_id % 40 AS STRING) || '","url":"https://d' || CAST(event_id % 7 AS STRING) || '.example/' || CAST(event_id AS STRING) || '","domain":"d' || CAST(event_id % 7 AS STRING) || '.example",' || CASE WHEN event_id % 3 = 0 THEN '"authorityClass":"news",' ELSE '' END || '"observedAt":"t' || CAST(1000000000000000 + event_id AS STRING) || '"}'
    WHEN 'click' THEN '{"sourceId":"s' || CAST(user_id % 40 AS STRING) || '","contentHash":"h' || CAST(event_id AS STRING) || '"}' WHEN 'error' THEN '{"sourceId":"s' || CAST(user_id % 40 + CASE WHEN user_id % 5 = 0 THEN 0 ELSE 1000 END AS STRING) || '"}'
    WHEN 'signup' THEN '{"id":"g' || CAST(event_id % 300 AS STRING) || '","fromClaimId":"c' || CAST(event_id % 11 AS STRING) || '","toClaimId":"c' || CAST(event_id % 13 AS STRING) || '","relation":"supports"}' ELSE '{"edgeId":"g' || CAST(event_id % 300 AS STRING) || '"}' END FROM events
UNION ALL SELECT 2000000000000000 + n_nationkey, 'r0', 'RUN_ROLLED_BACK', '{"run_id":"r' || CAST(n_nationkey * 3 AS STRING) || '"}' FROM nation WHERE n_nationkey < 8"""


def _event(kind: str, table: str, key: str, base: int, step: int, place: int, body: str, where: str = "true", entity: str | None = None, runs: int = 40) -> str:
    """Events of one kind, one a row: ``<expression>`` in ``body`` stands for its value."""
    pieces = re.split("<([^>]*)>", body)
    text = " || ".join(f"CAST({x} AS STRING)" if k % 2 else f"'{x}'" for k, x in enumerate(pieces) if x).replace("{k}", key)
    about = "" if entity is None else ", " + " || ".join(f"CAST({x} AS STRING)" if n % 2 else f"'{x}'" for n, x in enumerate(re.split("<([^>]*)>", entity)) if x).replace("{k}", key) + " AS entity_id"
    return f"SELECT {base} + {key} * {step} + {place} AS seq, 'r' || CAST({key} % {runs} AS STRING) AS run_id, '{kind}' AS event_type, {text} AS payload{about} FROM {table} WHERE {where.replace('{k}', key)}"


_KINDS = "CASE {k} % 6 WHEN 0 THEN 'same_claim' WHEN 1 THEN 'near_duplicate' WHEN 2 THEN 'elaboration' WHEN 3 THEN 'qualification' WHEN 4 THEN 'contradiction' ELSE 'new_claim' END"
_RELATIONS = "CASE {k} % 5 WHEN 0 THEN 'adjacent' WHEN 1 THEN 'contradicts' WHEN 2 THEN 'parent' WHEN 3 THEN 'child' ELSE 'supersedes' END"
_E, _P, _O = 10**12, 2 * 10**12, 3 * 10**12
#: A log of all kinds of events that change knowledge, over whole tables; ranges of places do not meet.
VIEWS["glog"] = "SELECT seq, run_id, event_type, 't' || CAST(seq AS STRING) AS timestamp, payload FROM (" + " UNION ALL ".join([
    _event("FAMILY_CREATED", "customer", "c_custkey", 0, 100, 1, '{"family_id":"f<{k} % 200>","label":"<c_name>","entityIds":["n<{k} % 60>","n<{k} % 7>"]}'),
    _event("FAMILY_RENAMED", "customer", "c_custkey", 0, 100, 2, '{"targetId":"f<{k} * 3 % 200>","newLabel":"L<{k}>"}', "{k} % 7 = 0"),
    _event("FAMILY_RESOLVED", "customer", "c_custkey", 0, 100, 3, '{"familyId":"f<{k} * 11 % 200>"}', "{k} % 5 = 0"),
    _event("FAMILY_CLASSIFIED", "customer", "c_custkey", 0, 100, 4, '{"entity_id":"n<{k} % 60>","family_id":"f<{k} * 7 % 200>","confidence":0.<{k} % 10>}', "{k} % 3 = 0"),
    _event("FAMILY_RELATED", "customer", "c_custkey", 0, 100, 5, '{"family_a":"f<{k} % 200>","family_b":"f<{k} * 7 % 200>","relation_type":"<' + _RELATIONS.replace("% 5", "/ 4 % 5").replace("{k} / 4", "CAST(floor({k} / 4) AS INT)") + '>"}', "{k} % 4 = 0"),
    _event("FAMILY_RELATION_REMOVED", "customer", "c_custkey", 0, 100, 6, '{"family_a":"f<({k} - 4) * 7 % 200>","family_b":"f<({k} - 4) % 200>"}', "{k} % 12 = 0"),
    _event("FAMILY_MERGED", "customer", "c_custkey", 0, 100, 7, '{"survivorFamilyId":"f<{k} % 200 + 1>","mergedFamilyIds":["f<{k} % 200>"]}', "{k} % 10 IN (3, 4) AND {k} % 3 = 0"),
    _event("THREAD_CREATED", "customer", "c_custkey", 0, 100, 8, '{"threadId":"t<{k} % 300>","familyId":"f<{k} % 200>","label":"T<{k}>"}'),
    _event("THREAD_RESOLVED", "customer", "c_custkey", 0, 100, 9, '{"threadId":"t<{k} * 5 % 300>"}', "{k} % 6 = 0"),
    _event("NODE_ADDED", "part", "p_partkey", _E, 100, 1, '{"id":"n<{k} % 700>","label":"<p_brand>","aliases":["a<{k} % 9>","b<{k} % 4>"]}'),
    _event("NODE_RELABELED", "part", "p_partkey", _E, 100, 2, '{"targetId":"n<{k} * 7 % 700>","newLabel":"R<{k}>"}', "{k} % 3 = 0"),
    _event("NODE_METADATA_UPDATED", "part", "p_partkey", _E, 100, 3, '{"targetId":"n<{k} * 11 % 700>","field":"x<{k} % 3>","newValue":"v<{k}>"}', "{k} % 2 = 0"),
    _event("ENTITY_MERGED", "part", "p_partkey", _E, 100, 4, '{"survivorId":"n<{k} % 700 + 1>","mergedIds":["n<{k} % 700>"],"mergedSnapshots":[{"id":"n<{k} % 700>","aliases":["m<{k} % 5>"]}]}', "{k} % 13 = 0"),
    _event("ENTITY_SPLIT", "part", "p_partkey", _E, 100, 5, '{"originalId":"n<{k} * 3 % 700>","resultingIds":["n<{k} % 5>","z"]}', "{k} % 17 = 0"),
    _event("CONTRADICTION_IDENTIFIED", "part", "p_partkey", _P, 100, 1, '{"id":"x<{k} % 90>","familyId":"f<{k} % 20>","claimIdA":"c<{k}>","claimIdB":"c<{k} + 1>"}', "{k} % 2 = 0"),
    _event("CONTRADICTION_RESOLVED", "part", "p_partkey", _P, 100, 2, '{"contradictionId":"x<{k} * 3 % 90>","newStatus":"resolved"}', "{k} % 5 = 0"),
    _event("GAP_OPENED", "part", "p_partkey", _P, 100, 3, '{"id":"g<{k} % 110>","familyId":"f<{k} % 20>","priority":<{k} % 5>}', "{k} % 2 = 1"),
    _event("GAP_RESOLVED", "part", "p_partkey", _P, 100, 4, '{"gapId":"g<{k} * 3 % 110>","newStatus":"<p_brand>"}', "{k} % 7 = 0"),
    _event("SOURCE_ADDED", "part", "p_partkey", _P, 100, 5, '{"id":"s<{k} % 80>","url":"https://e.example/<{k}>"<CASE WHEN {k} % 2 = 0 THEN \',"runCount":4\' ELSE \'\' END>}', "{k} % 3 = 0"),
    _event("CLAIM_ACCEPTED", "part", "p_partkey", _P, 100, 6, '{"id":"c<{k} % 150>","familyId":"f<{k} % 20>","confidence":0.<{k} % 10>}', "{k} % 3 = 1"),
    _event("CLAIM_OBSERVED", "orders", "o_orderkey", _O, 10, 1, '{"reconciliation":{"classification":"<' + _KINDS + '>","canonicalClaimId":"c<{k} % 700>","matchedClaimId":"c<{k} % 600>","score":0.<{k} % 10>}}'),
    _event("CLAIM_RETRACTION_SET", "orders", "o_orderkey", _O, 10, 2, '{"target":{"kind":"<CASE WHEN {k} % 2 = 0 THEN \'claim\' ELSE \'observation\' END>","id":"c<{k} % 300>"},"newStatus":"<CASE WHEN {k} % 3 = 0 THEN \'active\' ELSE \'retracted\' END>"}', "{k} % 9 = 0"),
    _event("EDGE_ADDED", "orders", "o_orderkey", _O, 10, 3, '{"id":"e<{k} % 200>","fromClaimId":"c<{k} % 90>","toClaimId":"c<{k} % 70>","relation":"supports"}', "{k} % 3 = 0"),
    _event("CLAIM_RELATION_CURATED", "orders", "o_orderkey", _O, 10, 4, '{"relationId":"e<{k} * 7 % 200>","before":{"relation":"supports"},"after":{"relation":"<CASE WHEN {k} % 2 = 0 THEN \'contradicts\' ELSE \'supports\' END>"}}', "{k} % 8 = 0"),
    _event("EVIDENCE_LINKED", "orders", "o_orderkey", _O, 10, 5, '{"id":"v<{k} % 800>","claimId":"c<{k} % 700>","stance":"<CASE WHEN {k} % 2 = 0 THEN \'supports\' ELSE \'opposes\' END>"}'),
    _event("EVIDENCE_STANCE_OVERRIDDEN", "orders", "o_orderkey", _O, 10, 6, '{"evidenceId":"v<{k} * 3 % 800>","newStance":"context"}', "{k} % 11 = 0"),
    _event("CLAIM_SPLIT", "orders", "o_orderkey", _O, 10, 7, '{"sourceClaimId":"c<{k}>","results":[{"claimId":"d<{k}>","observationIds":["o<{k} % 2>","o9"],"evidenceIds":[]},{"claimId":"d<{k} + 1>","observationIds":["o<{k} % 4>"],"evidenceIds":["v1"]}]}', "{k} % 50 = 0"),
]) + ") AS g"
_R = 97
#: A log of events that need compensation when their run is rolled back.
VIEWS["rlog"] = "SELECT seq, run_id, event_type, entity_id, payload FROM (" + " UNION ALL ".join([
    _event("NODE_ADDED", "part", "p_partkey", 0, 100, 1, '{"id":"n<{k} % 900>"}', "{k} % 3 = 0", "n<{k} % 900>", _R),
    _event("NODE_RELABELED", "part", "p_partkey", 0, 100, 2, '{"targetId":"n<{k} * 7 % 900>","oldLabel":"a<{k}>","newLabel":"b<{k}>"}', "{k} % 40 = 3", "n<{k} * 7 % 900>", _R),
    _event("NODE_METADATA_UPDATED", "part", "p_partkey", 0, 100, 3, '{"targetId":"n<{k} * 11 % 900>","field":"x","oldValue":"a","newValue":"b<{k}>"}', "{k} % 50 = 1", "n<{k} * 11 % 900>", _R),
    _event("SOURCE_ADDED", "part", "p_partkey", 0, 100, 4, '{"id":"s<{k} % 300>","url":"u<{k}>"}', "{k} % 4 = 0", "s<{k} % 300>", _R),
    _event("SOURCE_CHANGED", "part", "p_partkey", 0, 100, 5, '{"sourceId":"s<{k} % 300>","oldContentHash":"o","newContentHash":"h<{k}>"}', "{k} % 60 = 1", "s<{k} % 300>", _R),
    _event("SOURCE_RETRACTED", "part", "p_partkey", 0, 100, 6, '{"sourceId":"s<{k} % 310>"}', "{k} % 70 = 8", "s<{k} % 310>", _R),
    _event("FAMILY_MERGED", "part", "p_partkey", 0, 100, 7, '{"survivorFamilyId":"f<{k}>","mergedFamilyIds":["f<{k} + 1>","f<{k} + 2>"],"mergedSnapshots":[{"id":"f<{k} + 1>","label":"L<{k}>"}]}', "{k} % 55 = 5", "f<{k}>", _R),
    _event("FAMILY_RELATION_REMOVED", "part", "p_partkey", 0, 100, 8, '{"relation_id":"q<{k}>","family_a":"f<{k} * 3>","family_b":"f<{k} * 2>","relation_type":"adjacent"}', "{k} % 65 = 9", "f<{k} * 3>", _R),
    _event("GAP_RESOLVED", "part", "p_partkey", 0, 100, 9, '{"gapId":"g<{k} % 500>","previousStatus":"open","newStatus":"resolved"}', "{k} % 30 = 4", "g<{k} % 500>", _R),
    _event("ENTITY_MERGED", "part", "p_partkey", 0, 100, 10, '{"survivorId":"n<{k} % 900>","mergedIds":["n<{k} * 2 % 900>"],"mergedSnapshots":[{"id":"n<{k} * 2 % 900>","label":"l","aliases":["x"]}]}', "{k} % 75 = 2", "n<{k} % 900>", _R),
    _event("ENTITY_SPLIT", "part", "p_partkey", 0, 100, 11, '{"originalId":"m<{k}>","resultingIds":["m<{k} + 1>"],"restoredSnapshots":[{"id":"m<{k} + 1>","label":"l","aliases":["x"]}]}', "{k} % 85 = 2", "m<{k}>", _R),
    _event("CLAIM_MERGED", "part", "p_partkey", 0, 100, 12, '{"sourceClaimId":"c<{k}>","survivorClaimId":"d<{k}>"}', "{k} % 200 = 11", "c<{k}>", _R),
    _event("RUN_ROLLED_BACK", "part", "p_partkey", 0, 100, 13, '{"run_id":"r<{k} % 97>"}', "{k} % 333 = 12", "none<{k}>", _R),
]) + ") AS r"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Model:
    """Lazy DataFrames over one folder of tables: ``m.claims``, ``m.lineitem``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name not in VIEWS:
            raise AttributeError(name)
        sql, used = VIEWS[name], {}
        for table in TABLES:
            if f"FROM {table}" in sql or f"JOIN {table}" in sql:
                used[table] = self.table(table)
                sql = sql.replace(f"FROM {table}", f"FROM \x01{table}\x02").replace(f"JOIN {table} ON", f"JOIN \x01{table}\x02 ON")
        sql = sql.replace("{", "{{").replace("}", "}}").replace("\x01", "{").replace("\x02", "}")
        return self.spark.sql(sql, **used)


def with_views(sql: str) -> str:
    """``sql`` for the other engine, with the views that it names in front."""
    used = [name for name in VIEWS if f" {name}" in sql.replace("\n", " ")]
    head = ", ".join(f"{name} AS ({VIEWS[name]})" for name in used)
    body = sql.strip()
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {head}, {body[4:]}"
    return f"WITH {head} {body}"


def ordered(*columns: str):
    return [F.col(c.removeprefix("-")).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_first() for c in columns]
