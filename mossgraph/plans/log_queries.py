"""Projections from the log, provider responses, passages, streams and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import projection, research
from ..operators.graph import shared_folder
from ..sources import providers
from ..sources.events import EventLog
from ..streaming import incremental, runs
from .model import Model
from .registry import ORACLE_SQL, also_as, query

J = "json_extract_string(payload, '$.{0}')"
LIVE = f"""rolled AS (SELECT DISTINCT {J.format('run_id')} AS r FROM klog WHERE event_type = 'RUN_ROLLED_BACK'),
own AS (SELECT DISTINCT {J.format('id')} AS e, run_id AS r FROM klog WHERE event_type = 'EDGE_ADDED'),
live AS (SELECT * FROM klog k WHERE event_type <> 'RUN_ROLLED_BACK' AND NOT (run_id IN (SELECT r FROM rolled) AND (event_type NOT IN ('CLAIM_MERGED', 'SOURCE_RETRACTED', 'EDGE_REMOVED')
 OR (event_type = 'EDGE_REMOVED' AND EXISTS (SELECT 1 FROM own WHERE own.e = json_extract_string(k.payload, '$.edgeId') AND own.r = k.run_id)))))"""
MERGED = f"""merged AS (SELECT {J.format('claimId')} AS a, {J.format('intoClaimId')} AS b FROM live WHERE event_type = 'CLAIM_MERGED'),
chain AS (SELECT a, b FROM merged UNION ALL SELECT c.a, m.b FROM chain c JOIN merged m ON c.b = m.a), alias AS (SELECT a, b FROM chain WHERE b NOT IN (SELECT a FROM merged))"""


@query(f"WITH RECURSIVE {LIVE} SELECT seq, run_id, event_type FROM live")
def rep04_live_events(m: Model) -> DataFrame:
    return projection.live_events(m.klog).select("seq", "run_id", "event_type")


@query(f"WITH RECURSIVE {LIVE}, {MERGED} SELECT a AS id, b AS survivor FROM alias")
def pj16_survivors(m: Model) -> DataFrame:
    return projection.survivors(projection.live_events(m.klog), "CLAIM_MERGED", "claimId", "intoClaimId")


@query(f"""WITH RECURSIVE {LIVE}, {MERGED}, o AS (SELECT {J.format('claimId')} AS raw, seq, {J.format('familyId')} AS fam, {J.format('subject')} AS subject, {J.format('observedAt')} AS seen FROM live WHERE event_type = 'CLAIM_OBSERVED'),
o2 AS (SELECT o.*, coalesce(alias.b, raw) AS id FROM o LEFT JOIN alias ON alias.a = o.raw), g AS (SELECT id, arg_min(fam, seq) AS family_id, arg_min(subject, (CASE WHEN raw <> id THEN 1 ELSE 0 END) * 100000000 + seq) AS subject, count(*) AS n_observations, max(seen) AS last_seen_at FROM o2 GROUP BY id),
e AS (SELECT {J.format('id')} AS ev, arg_max({J.format('claimId')}, seq) AS raw, arg_max({J.format('stance')}, seq) AS stance FROM live WHERE event_type = 'EVIDENCE_LINKED' GROUP BY 1),
e2 AS (SELECT coalesce(alias.b, raw) AS id, count(*) FILTER (WHERE stance = 'supports') AS s, count(*) FILTER (WHERE stance = 'opposes') AS o FROM e LEFT JOIN alias ON alias.a = e.raw GROUP BY 1),
x AS (SELECT {J.format('claimId')} AS id, arg_max({J.format('expiredAt')}, seq) AS expired_at FROM live WHERE event_type = 'CLAIM_EXPIRED' GROUP BY 1)
SELECT g.id, family_id, subject, n_observations, last_seen_at, coalesce(s, 0) AS n_supports, coalesce(o, 0) AS n_opposes, expired_at FROM g LEFT JOIN e2 ON e2.id = g.id LEFT JOIN x ON x.id = g.id""")
def pj06_claims(m: Model) -> DataFrame:
    return projection.claims(projection.live_events(m.klog))


@query(f"""WITH RECURSIVE {LIVE}, o AS (SELECT {J.format('sourceId')} AS id, seq, {J.format('url')} AS url, {J.format('domain')} AS domain, {J.format('authorityClass')} AS auth, {J.format('observedAt')} AS seen FROM live WHERE event_type = 'SOURCE_OBSERVED'),
g AS (SELECT id, arg_min(url, seq) AS url, arg_min(domain, seq) AS domain, arg_min(auth, seq) FILTER (WHERE auth IS NOT NULL) AS authority, count(*) AS run_count, arg_min(seen, seq) AS first_seen_at, arg_max(seen, seq) AS last_seen_at FROM o GROUP BY id),
l AS (SELECT {J.format('sourceId')} AS id, arg_max({J.format('contentHash')}, seq) FILTER (WHERE {J.format('contentHash')} IS NOT NULL) AS content_hash, bool_or(event_type = 'SOURCE_RETRACTED') AS retracted FROM live WHERE event_type IN ('SOURCE_READ', 'SOURCE_CHANGED', 'SOURCE_RETRACTED') GROUP BY 1)
SELECT g.*, content_hash, coalesce(retracted, false) AS retracted FROM g LEFT JOIN l ON l.id = g.id""")
def pj12_sources(m: Model) -> DataFrame:
    return projection.sources(projection.live_events(m.klog))


@query(f"""WITH RECURSIVE {LIVE}, r AS (SELECT coalesce({J.format('id')}, {J.format('edgeId')}) AS id, seq, event_type, {J.format('fromClaimId')} AS from_id, {J.format('toClaimId')} AS to_id, {J.format('relation')} AS relation FROM live WHERE event_type IN ('EDGE_ADDED', 'EDGE_REMOVED')),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM r) SELECT id, from_id, to_id, relation FROM n WHERE n = 1 AND event_type = 'EDGE_ADDED' AND from_id <> to_id""")
def pj14_edges(m: Model) -> DataFrame:
    return projection.edges(projection.live_events(m.klog))


def _incremental(m: Model) -> str:
    return f"{shared_folder(m.spark)}/mossgraph/{uuid.uuid4().hex}"


@query()
def str01_incremental_claims(m: Model) -> DataFrame:
    """The claims of the whole log kept up over three batches of it, the last with rollbacks of runs of the others."""
    log = m.klog.select("seq", "run_id", "event_type", "payload")
    store = incremental.Incremental(m.spark, _incremental(m))
    third = F.pmod(F.xxhash64("seq"), F.lit(3))
    for k in range(3):
        store.apply(log.where(F.when(F.col("event_type") == "RUN_ROLLED_BACK", 2).otherwise(third) == k))
    return store.views()["claims"]


@query()
def rep05_from_checkpoint(m: Model) -> DataFrame:
    """The claims of the whole log from a checkpoint before its rollbacks and the events since."""
    log, folder = m.klog.select("seq", "run_id", "event_type", "payload"), _incremental(m)
    incremental.resumed(m.spark, folder, log.where("seq < 1000000000000000"))
    return incremental.resumed(m.spark, folder, log)[0].views()["claims"]


ORACLE_SQL |= {"str01_incremental_claims": ORACLE_SQL["pj06_claims"], "rep05_from_checkpoint": ORACLE_SQL["pj06_claims"]}


# Names from when the queries above read a part of their tables.
for _name in ("rep04_live_events", "pj16_survivors", "pj06_claims", "pj12_sources", "pj14_edges"):
    also_as(f"{_name}_whole", _name)


BODY = """'{"' || CASE page_id % 3 WHEN 0 THEN 'results' WHEN 1 THEN 'items' ELSE 'papers' END || '":[{"url":"' || url || '","title":"T' || CAST(page_id AS STRING) || '","abstract":"a"},{"link":"http://localhost/x","title":"no"},{"link":"' || url || '","description":"untitled"}]}'"""


@query("SELECT page_id AS id, 0 AS ord, url, 'T' || CAST(page_id AS STRING) AS title, 'a' AS snippet FROM pages WHERE regexp_matches(url, '^(?i)https?://[^/?#@]+')")
def src10_hits(m: Model) -> DataFrame:
    responses = m.pages.where(~F.col("url").contains('"')).select(F.col("page_id").alias("id"), F.expr(BODY).alias("body"))
    return providers.hits(responses).select("id", "ord", "url", "title", "snippet")


@query("""SELECT page_id AS id, CASE WHEN page_id % 2 = 0 THEN repeat('é', 1022) || '…' ELSE repeat('é', 1024) END AS title, CASE WHEN page_id % 3 = 0 THEN repeat('x', 16381) || '…' ELSE repeat('x', 5000) END AS snippet
FROM pages WHERE regexp_matches(url, '^(?i)https?://[^/?#@]+')""")
def src10_long_fields(m: Model) -> DataFrame:
    """Titles above and at 2 KiB of UTF-8, snippets above and below 16 KiB."""
    n = F.col("page_id")
    hit = F.struct(F.col("url"), F.repeat(F.lit("é"), F.when(n % 2 == 0, 3000).otherwise(1024)).alias("title"), F.repeat(F.lit("x"), F.when(n % 3 == 0, 20_000).otherwise(5000)).alias("description"))
    responses = m.pages.where(~F.col("url").contains('"')).select(n.alias("id"), F.to_json(F.struct(F.array(hit).alias("results"))).alias("body"))
    return providers.hits(responses).select("id", "title", "snippet")


@query("SELECT page_id AS id, count(*) AS n FROM pages, range(3) GROUP BY 1")
def src09_result_arrays(m: Model) -> DataFrame:
    responses = m.pages.select(F.col("page_id").alias("id"), F.expr(BODY).alias("body"))
    return providers.results(responses).groupBy("id").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, 'own' || CAST(p_size AS STRING) || '/r' AS repo, CAST(p_size AS BIGINT) AS stars FROM part")
def src13_repositories(m: Model) -> DataFrame:
    body = F.concat(F.lit('[{"html_url":"https://github.com/own'), F.col("p_size").cast("string"), F.lit('/r?x=1","stars":'), F.col("p_size").cast("string"), F.lit("}]"))
    return providers.repositories(m.part.select(F.col("p_partkey").alias("id"), body.alias("body"))).select("id", "repo", "stars")


@query()
def al17_segments(m: Model) -> DataFrame:
    return research.segmented(m.documents).select("id", "n", "start", "end")


@query()
def al18_passages(m: Model) -> DataFrame:
    return research.selected(research.segmented(m.documents, size=600), "the thing that was tion")


@query("""WITH t AS (SELECT o_custkey AS family_id, CASE WHEN o_orderkey % 2 = 0 THEN 'gap' ELSE 'contradiction' END AS type, o_orderkey AS id, CAST(o_orderkey % 4 AS DOUBLE) AS priority FROM orders WHERE o_orderkey % 6 <> 0)
SELECT family_id, type, id, priority FROM (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY priority, type, id) AS n FROM t) WHERE n = 1""")
def pg06_follow_up(m: Model) -> DataFrame:
    k = F.col("o_orderkey")
    t = m.orders.select(F.col("o_custkey").alias("family_id"), F.when(k % 2 == 0, F.lit("gap")).otherwise(F.lit("contradiction")).alias("type"), k.alias("id"), (k % 4).cast("double").alias("priority"))
    return research.follow_up(t, t.where("id % 6 = 0"))


@query("""WITH t AS (SELECT o_custkey AS family_id, CASE WHEN o_orderkey % 2 = 0 THEN 'gap' ELSE 'contradiction' END AS type, o_orderkey AS id, o_orderkey % 4 AS priority FROM orders WHERE o_orderkey % 3 > 0),
d AS (SELECT o_custkey AS family_id, o_orderkey AS id FROM orders WHERE o_orderkey % 6 = 0 OR o_orderkey % 8 = 1), u AS (SELECT family_id, count(*) AS used FROM d GROUP BY 1),
l AS (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY priority, type, id) AS n FROM t WHERE (family_id, id) NOT IN (SELECT (family_id, id) FROM d))
SELECT c_custkey AS family_id, CASE WHEN coalesce(used, 0) >= 3 THEN 'cap_reached' WHEN id IS NULL THEN 'no_work' ELSE 'queued' END AS status, coalesce(used, 0) + CASE WHEN coalesce(used, 0) < 3 AND id IS NOT NULL THEN 1 ELSE 0 END AS used,
 CASE WHEN coalesce(used, 0) < 3 THEN type END AS type, CASE WHEN coalesce(used, 0) < 3 THEN id END AS id FROM customer LEFT JOIN u ON u.family_id = c_custkey LEFT JOIN l ON l.family_id = c_custkey AND l.n = 1""")
def r_continue(m: Model) -> DataFrame:
    """What follows up on each family: three times at most."""
    k = F.col("o_orderkey")
    rows = m.orders.select(F.col("o_custkey").alias("family_id"), F.when(k % 2 == 0, F.lit("gap")).otherwise(F.lit("contradiction")).alias("type"), k.alias("id"), (k % 4).alias("priority"))
    return research.continued(m.customer.select(F.col("c_custkey").alias("family_id")), rows.where("id % 3 > 0"), rows.where("id % 6 = 0 or id % 8 = 1"))


@query(f"""WITH RECURSIVE o AS (SELECT run_id, event_type, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS n FROM log),
f AS (SELECT DISTINCT run_id, CAST(0 AS BIGINT) AS n, 'none' AS status FROM o UNION ALL SELECT f.run_id, o.n, CASE WHEN o.event_type = 'RUN_QUEUED' AND f.status = 'none' THEN 'queued' WHEN o.event_type = 'RUN_FAILED' AND f.status = 'queued' THEN 'failed' ELSE f.status END
FROM f JOIN o ON o.run_id = f.run_id AND o.n = f.n + 1) SELECT run_id, arg_max(status, n) AS status FROM f GROUP BY 1""")
def str04_ledger_stream(m: Model) -> DataFrame:
    """The ledger as a stream over the log's files, drained into a table."""
    spark = m.spark
    folder = f"{shared_folder(spark)}/mossgraph/stream-{uuid.uuid4().hex}"
    log = m.log.select("run_id", "seq", "event_type")
    log.write.mode("overwrite").parquet(f"{folder}/in")
    stream = spark.readStream.schema(log.schema).parquet(f"{folder}/in")
    done = runs.keep_latest(runs.ledger_stream(stream), f"{folder}/out", "run_id", f"{folder}/checkpoint")
    return runs.drain(done, lambda: runs.latest_of(spark, f"{folder}/out").select("run_id", "status"))


@query("SELECT o_orderkey AS seq_source, CAST(row_number() OVER (ORDER BY o_orderkey % 20000 >= 9000, o_orderkey) AS BIGINT) AS seq FROM orders")
def snk01_append(m: Model) -> DataFrame:
    """Two batches appended to a new log, read back in order."""
    log = EventLog(m.spark, f"{shared_folder(m.spark)}/mossgraph/log-{uuid.uuid4().hex}")
    rows = m.orders.select(
        F.col("o_orderkey").alias("ord"), F.lit("2024-01-01").alias("timestamp"), F.lit("CLAIM_OBSERVED").alias("event_type"), F.lit("r").alias("run_id"), F.lit("agent").alias("actor"), F.lit(None).cast("string").alias("entity_id"),
        F.concat(F.lit('{"k":'), F.col("o_orderkey").cast("string"), F.lit("}")).alias("payload"),
    )
    at = log.append(rows.where("ord % 20000 < 9000"), 0)
    log.append(rows.where("ord % 20000 >= 9000"), at)
    return log.scan().select(projection.payload("k", "long").alias("seq_source"), "seq")
