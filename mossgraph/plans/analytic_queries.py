"""Epistemics, coverage, gaps, ledgers, projections, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.addresses import AUTHORITY, AUTHORITY_WEIGHT
from ..operators import epistemics, evaluate, graph, ledger, research
from .model import Model
from .registry import also_as, query

WEIGHT = "CASE authority_class " + " ".join(f"WHEN '{a}' THEN {w}" for a, w in zip(AUTHORITY, AUTHORITY_WEIGHT, strict=True)) + " ELSE 0.5 END"
KIND = "CASE evidence_type WHEN 'study' THEN 1.0 WHEN 'benchmark' THEN 1.0 WHEN 'claim' THEN 0.7 WHEN 'opinion' THEN 0.5 ELSE 0.4 END"
AS_OF = "1999-01-01"


#: Sources with dates and contents, observations with two sources each, evidence of observations, and records of contradictions.
EPISTEMIC = f"""src AS (SELECT id, domain, CASE WHEN id % 4 > 0 THEN authority_class END AS authority_class, CASE WHEN id % 3 = 0 THEN CAST(1996 + id % 3 AS STRING) || '-03-01' END AS published_at,
 CASE WHEN id % 3 = 1 THEN '1997-0' || CAST(id % 9 + 1 AS STRING) || '-15' END AS retrieved_at, CASE WHEN id % 2 = 0 THEN 'h' || CAST(id % 9 AS STRING) END AS content_hash FROM sources),
obs AS (SELECT id, claim_id, confidence, evidence_type, CASE WHEN subject_id % 5 = 0 THEN 'vendor_docs' END AS authority_class, observed_at, source_id AS first_source, source_id % 10 + 1 AS second_source, CASE WHEN subject_id % 6 = 5 THEN 'retracted' END AS status FROM evidence WHERE stance <> 'opposes'),
evi AS (SELECT id, claim_id, source_id, CASE WHEN stance <> 'opposes' THEN id END AS observation_id, stance, CASE WHEN subject_id % 3 = 0 THEN 'x' || CAST(subject_id % 4 AS STRING) END AS excerpt FROM evidence),
con AS (SELECT id AS claim_a, id + 1 AS claim_b, CASE WHEN id % 2 = 0 THEN 'unresolved' ELSE 'resolved' END AS status FROM claims WHERE id % 13 < 2)"""


@query(f"""WITH RECURSIVE {EPISTEMIC}, ob AS (SELECT * FROM obs WHERE status IS NULL), ev AS (SELECT * FROM evi WHERE observation_id IS NULL OR observation_id NOT IN (SELECT id FROM obs WHERE status = 'retracted')),
ow AS (SELECT ob.claim_id, ob.confidence, coalesce(ob.authority_class, a.authority_class, b.authority_class) AS authority_class, evidence_type,
 coalesce(greatest(CAST(coalesce(a.published_at, a.retrieved_at) AS DATE), CAST(coalesce(b.published_at, b.retrieved_at) AS DATE)), CAST(observed_at AS DATE)) AS dated FROM ob LEFT JOIN src a ON a.id = first_source LEFT JOIN src b ON b.id = second_source),
ww AS (SELECT *, {WEIGHT} AS aw, {WEIGHT} * {KIND} * greatest(0.5, pow(0.5, greatest(date_diff('day', dated, DATE '{AS_OF}'), 0) / 365.25)) AS w FROM ow),
so AS (SELECT claim_id, count(*) AS n_obs, sum(w) AS w, sum(w * confidence) AS wc, max(aw) AS best FROM ww GROUP BY 1),
se AS (SELECT ev.claim_id, count(*) AS n_ev, count(*) FILTER (WHERE stance = 'supports') AS n_sup, count(*) FILTER (WHERE stance = 'opposes') AS n_opp, sum(CASE WHEN stance = 'opposes' THEN {WEIGHT} ELSE 0 END) AS opp FROM ev LEFT JOIN src ON src.id = ev.source_id GROUP BY 1),
rec AS (SELECT c AS claim_id, bool_or(status = 'unresolved') AS live FROM (SELECT claim_a AS c, status FROM con UNION ALL SELECT claim_b, status FROM con) GROUP BY 1),
ln AS (SELECT DISTINCT claim_id, s FROM (SELECT claim_id, first_source AS s FROM ob UNION ALL SELECT claim_id, second_source FROM ob UNION ALL SELECT claim_id, source_id FROM ev)),
ex AS (SELECT claim_id, source_id AS s, arg_min(excerpt, id) AS excerpt FROM ev WHERE excerpt <> '' GROUP BY 1, 2),
lk AS (SELECT DISTINCT ln.claim_id, 'd' || src.domain AS dom, 'c' || coalesce(content_hash, excerpt) AS content FROM ln JOIN src ON src.id = ln.s LEFT JOIN ex ON ex.claim_id = ln.claim_id AND ex.s = ln.s),
ed AS (SELECT claim_id, dom AS a, content AS b FROM lk WHERE content IS NOT NULL UNION SELECT claim_id, content, dom FROM lk WHERE content IS NOT NULL),
rr AS (SELECT DISTINCT claim_id, dom AS a, dom AS b FROM lk UNION SELECT rr.claim_id, rr.a, ed.b FROM rr JOIN ed ON rr.claim_id = ed.claim_id AND rr.b = ed.a),
nd AS (SELECT claim_id, count(DISTINCT root) AS nd FROM (SELECT claim_id, a, min(b) AS root FROM rr WHERE b LIKE 'd%' GROUP BY 1, 2) GROUP BY 1),
al AS (SELECT c.id AS claim_id, coalesce(n_obs, 0) AS n_obs, coalesce(n_ev, 0) AS n_ev, coalesce(n_sup, 0) AS n_sup, coalesce(n_opp, 0) AS n_opp, opp, w, wc, best, coalesce(nd, 0) AS nd,
 CASE WHEN live THEN 'contested' WHEN NOT live THEN 'resolved' WHEN n_sup > 0 AND n_opp > 0 THEN 'contested' ELSE 'none' END AS state FROM claims c LEFT JOIN so ON so.claim_id = c.id LEFT JOIN se ON se.claim_id = c.id LEFT JOIN rec ON rec.claim_id = c.id LEFT JOIN nd ON nd.claim_id = c.id)
SELECT claim_id, round(round(greatest(0, least(1, coalesce(CASE WHEN w > 0 THEN wc / w END, 0) * (1 - CASE WHEN n_opp > 0 AND (n_sup > 0 OR n_obs > 0) THEN least(opp / greatest(n_sup, 1), 0.8) ELSE 0 END)))::DOUBLE, 9), 3) AS confidence, state AS contradiction_state,
 CASE WHEN state = 'contested' THEN 'conflicting' WHEN n_obs > 0 AND best >= 0.85 THEN 'primary' WHEN n_obs > 0 AND best >= 0.6 THEN 'secondary' ELSE 'weak' END AS support_level,
 CASE WHEN n_obs = 0 THEN 'unknown' WHEN state = 'contested' THEN 'contested' WHEN n_obs >= 2 AND nd >= 2 THEN 'consensus' WHEN n_ev > 0 OR n_obs >= 2 THEN 'emerging' ELSE 'speculative' END AS epistemic_status, nd AS n_independent FROM al""")
def ep01_epistemic_state(m: Model) -> DataFrame:
    """Confidence, contradiction records, independent sources and status of every claim."""
    src, obs, evi, con = _epistemic(m)
    return epistemics.epistemic_state(m.claims, obs, evi, src, con, AS_OF)


@query(f"WITH {EPISTEMIC} SELECT id, claim_id, stance FROM evi WHERE observation_id IS NULL OR observation_id NOT IN (SELECT id FROM obs WHERE status = 'retracted')")
def flt06_unretracted_evidence(m: Model) -> DataFrame:
    _, obs, evi, _ = _epistemic(m)
    return epistemics.active_evidence(evi, obs).select("id", "claim_id", "stance")


def _epistemic(m: Model) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    n, k = F.col("id"), F.col("subject_id")
    src = m.sources.select(
        "id", "domain", F.when(n % 4 > 0, F.col("authority_class")).alias("authority_class"), F.when(n % 3 == 0, F.concat((n % 3 + 1996).cast("string"), F.lit("-03-01"))).alias("published_at"),
        F.when(n % 3 == 1, F.concat(F.lit("1997-0"), (n % 9 + 1).cast("string"), F.lit("-15"))).alias("retrieved_at"), F.when(n % 2 == 0, F.concat(F.lit("h"), (n % 9).cast("string"))).alias("content_hash"),
    )
    said = m.evidence.where("stance <> 'opposes'")
    obs = said.select("id", "claim_id", "confidence", "evidence_type", F.when(k % 5 == 0, F.lit("vendor_docs")).alias("authority_class"), "observed_at", F.array(F.col("source_id"), (F.col("source_id") % 10 + 1).cast(said.schema["source_id"].dataType)).alias("source_ids"), F.when(k % 6 == 5, F.lit("retracted")).alias("status"))
    evi = m.evidence.select("id", "claim_id", "source_id", F.when(F.col("stance") != "opposes", F.col("id")).alias("observation_id"), "stance", F.when(k % 3 == 0, F.concat(F.lit("x"), (k % 4).cast("string"))).alias("excerpt"))
    con = m.claims.where("id % 13 < 2").select(n.alias("claim_a"), (n + 1).alias("claim_b"), F.when(n % 2 == 0, F.lit("unresolved")).otherwise(F.lit("resolved")).alias("status"))
    return src, obs, evi, con


@query("""WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey % 50 AS claim_id, 'd' || (l_suppkey % 13) AS domain, CASE WHEN l_partkey % 3 > 0 THEN 'c' || (l_partkey % 29) END AS content FROM lineitem),
e AS (SELECT claim_id, domain AS a, content AS b FROM l WHERE content IS NOT NULL UNION SELECT claim_id, content, domain FROM l WHERE content IS NOT NULL),
r AS (SELECT DISTINCT claim_id, domain AS a, domain AS b FROM l UNION SELECT r.claim_id, r.a, e.b FROM r JOIN e ON r.claim_id = e.claim_id AND r.b = e.a),
g AS (SELECT claim_id, a, min(b) AS root FROM r WHERE b LIKE 'd%' GROUP BY 1, 2) SELECT claim_id, count(DISTINCT root) AS n_independent FROM g GROUP BY 1""")
def ag05_independent_sources(m: Model) -> DataFrame:
    return _independent(m.lineitem)


also_as("ag05_independent_sources_whole", "ag05_independent_sources")


def _independent(l: DataFrame) -> DataFrame:  # noqa: E741
    rows = l.select((F.col("l_orderkey") % 50).alias("claim_id"), F.concat(F.lit("d"), (F.col("l_suppkey") % 13).cast("string")).alias("domain"), F.when(F.col("l_partkey") % 3 > 0, F.concat(F.lit("c"), (F.col("l_partkey") % 29).cast("string"))).alias("content"))
    return epistemics.independent_sources(rows)


@query("SELECT authority_class, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, authority_class) AS place, count(*) OVER () AS kinds FROM sources GROUP BY 1")
def ag08_sources_by_type(m: Model) -> DataFrame:
    return research.by_type(m.sources, "authority_class")


@query("SELECT family_id, status FROM (SELECT family_id, epistemic_status AS status, row_number() OVER (PARTITION BY family_id ORDER BY count(*) DESC, min(id)) AS n FROM claims GROUP BY family_id, epistemic_status) WHERE n = 1")
def ag09_mode_status(m: Model) -> DataFrame:
    return research.most_common(m.claims, "family_id", F.col("epistemic_status")).withColumnRenamed("value", "status")


@query("SELECT f AS family_id, kind, round(n / total::DOUBLE, 6) AS share FROM (SELECT s_nationkey AS f, CASE WHEN s_suppkey % 9 < 7 THEN 'web' ELSE 'news' END AS kind, count(*) AS n, sum(count(*)) OVER (PARTITION BY s_nationkey) AS total FROM supplier GROUP BY 1, 2) WHERE n / total::DOUBLE > 0.7")
def ag10_dominant_type(m: Model) -> DataFrame:
    rows = m.supplier.select(F.col("s_nationkey").alias("family_id"), F.when(F.col("s_suppkey") % 9 < 7, F.lit("web")).otherwise(F.lit("news")).alias("kind"))
    return research.dominant(rows, "family_id", "kind")


@query("SELECT family_id, len(k) AS present, array_to_string(list_sort(list_filter(['consensus', 'contested', 'emerging', 'speculative', 'unknown'], lambda x: NOT list_contains(k, x))), ',') AS missing FROM (SELECT family_id, list_distinct(list(epistemic_status)) AS k FROM claims GROUP BY 1) WHERE len(k) < 3")
def ag11_missing_types(m: Model) -> DataFrame:
    kinds = F.array(*map(F.lit, ("consensus", "contested", "emerging", "speculative", "unknown")))
    c = m.claims.groupBy("family_id").agg(F.collect_set("epistemic_status").alias("k")).where(F.size("k") < 3)
    return c.select("family_id", F.size("k").cast("long").alias("present"), F.array_join(F.array_sort(F.array_except(kinds, "k")), ",").alias("missing"))


COVERAGE = """WITH g AS (SELECT e.subject_id AS sub_question, count(DISTINCT e.source_id) AS n_sources, count(DISTINCT s.domain) AS n_domains, count(*) AS n_findings, round(avg(e.confidence)::DOUBLE, 6) AS depth, bool_or(s.extraction_status = 'failed') AS promo
FROM evidence e JOIN sources s ON e.source_id = s.id GROUP BY 1), q AS (SELECT p_partkey AS sub_question FROM part)
SELECT sub_question, coalesce(n_sources, 0) AS n_sources, coalesce(n_domains, 0) AS n_domains, coalesce(n_findings, 0) AS n_findings,
 CASE WHEN n_sources IS NULL THEN 'uncovered' WHEN n_sources < 2 OR n_domains < 2 THEN 'thin' WHEN promo OR depth < 0.04 THEN 'risky' ELSE 'adequate' END AS status FROM q LEFT JOIN g USING (sub_question)"""


def _coverage(m: Model) -> DataFrame:
    s = m.sources.select(F.col("id").alias("source_id"), "domain", (F.col("extraction_status") == "failed").alias("failed"))
    links = m.evidence.select(F.col("subject_id").alias("question"), "source_id", "confidence").join(s, "source_id")
    return research.question_coverage(m.part.select(F.col("p_partkey").alias("question")), links, m.lineitem.count()).withColumnRenamed("question", "sub_question")


@query(COVERAGE)
def ag12_coverage(m: Model) -> DataFrame:
    return _coverage(m)


@query(f"SELECT 'thin_coverage::' || CAST(sub_question AS STRING) AS gap, 1 AS priority FROM ({COVERAGE}) WHERE status IN ('thin', 'uncovered') UNION ALL SELECT 'risky::' || CAST(sub_question AS STRING), 2 FROM ({COVERAGE}) WHERE status = 'risky'")
def al21_coverage_gaps(m: Model) -> DataFrame:
    c = _coverage(m).where("status <> 'adequate'")
    risky = F.col("status") == "risky"
    return c.select(F.concat(F.when(risky, F.lit("risky::")).otherwise(F.lit("thin_coverage::")), F.col("sub_question").cast("string")).alias("gap"), F.when(risky, F.lit(2)).otherwise(F.lit(1)).alias("priority"))


@query(f"SELECT count(*) > 0 AND bool_and(status = 'adequate') AS adequate, count(*) FILTER (WHERE status = 'adequate') AS n_adequate, count(*) AS n FROM ({COVERAGE})")
def rs05_coverage_adequate(m: Model) -> DataFrame:
    ok = F.col("status") == "adequate"
    return _coverage(m).agg((F.coalesce(F.bool_and(ok), F.lit(False))).alias("adequate"), F.count_if(ok).alias("n_adequate"), F.count("*").alias("n"))


@query("SELECT family_id, count(DISTINCT source_id) AS n_sources FROM claims c JOIN evidence e ON e.claim_id = c.id GROUP BY 1")
def ag18_family_sources(m: Model) -> DataFrame:
    c = m.claims.select(F.col("id").alias("claim_id"), "family_id")
    return m.evidence.select("claim_id", "source_id").join(c, "claim_id").groupBy("family_id").agg(F.countDistinct("source_id").alias("n_sources"))


@query("SELECT CAST(l_linenumber AS INT) AS line, CASE WHEN count(*) >= 3 THEN 'confirmed' WHEN count(*) = 2 THEN 'corroborated' ELSE 'unverified' END AS tier, l_orderkey AS finding FROM lineitem GROUP BY l_orderkey, l_linenumber")
def ag16_tiers(m: Model) -> DataFrame:
    g = m.lineitem.groupBy(F.col("l_orderkey").alias("finding"), F.col("l_linenumber").cast("int").alias("line")).agg(F.count("*").alias("n"))
    return g.select("line", F.when(F.col("n") >= 3, F.lit("confirmed")).when(F.col("n") == 2, F.lit("corroborated")).otherwise(F.lit("unverified")).alias("tier"), "finding")


@query("SELECT run_id, arg_max(event_type, seq) AS last_event, max(seq) AS last_seq, count(*) FILTER (WHERE event_type = 'RUN_FAILED') AS n_failed, count(*) AS n_events FROM log GROUP BY 1")
def r_latest_state(m: Model) -> DataFrame:
    return ledger.latest_state(m.log)


@query("""WITH RECURSIVE o AS (SELECT run_id, event_type, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS n FROM log),
f AS (SELECT run_id, CAST(0 AS BIGINT) AS n, 'none' AS status, CAST(0 AS BIGINT) AS applied, CAST(0 AS BIGINT) AS illegal FROM (SELECT DISTINCT run_id FROM o)
UNION ALL SELECT f.run_id, o.n, coalesce(t.to_, f.status), f.applied + CASE WHEN t.to_ IS NULL THEN 0 ELSE 1 END, f.illegal + CASE WHEN t.to_ IS NULL THEN 1 ELSE 0 END
FROM f JOIN o ON o.run_id = f.run_id AND o.n = f.n + 1 LEFT JOIN (VALUES ('RUN_QUEUED', 'none', 'queued'), ('RUN_RUNNING', 'starting', 'running'), ('RUN_FAILED', 'queued', 'failed'), ('RUN_FAILED', 'starting', 'failed'), ('RUN_FAILED', 'running', 'failed'),
('RUN_COMPLETED', 'running', 'completed'), ('RUN_PROGRESS', 'running', 'running')) t(e, from_, to_) ON t.e = o.event_type AND t.from_ = f.status)
SELECT run_id, status, applied, illegal FROM f WHERE n = (SELECT max(n) FROM o WHERE o.run_id = f.run_id)""")
def str04_ledger(m: Model) -> DataFrame:
    return ledger.folded_runs(m.log)


@query("""SELECT key, seq, round(avg(failed::INT) OVER w::DOUBLE, 6) AS rate, count(*) OVER w AS n, count(*) OVER w >= 5 AND avg(failed::INT) OVER w > 0.8 AS open FROM (SELECT user_id AS key, event_id AS seq, event_type IN ('error', 'click') AS failed FROM events)
WINDOW w AS (PARTITION BY key ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def wn06_breaker_windows(m: Model) -> DataFrame:
    return ledger.failure_windows(m.events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").isin("error", "click").alias("failed")))


@query("SELECT run_id, seq, sum(CASE WHEN event_type = 'RUN_PROGRESS' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY seq)::BIGINT AS spent, sum(CASE WHEN event_type = 'RUN_PROGRESS' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY seq) >= 5 AS exhausted FROM log")
def str10_budget(m: Model) -> DataFrame:
    return ledger.spent(m.log, "RUN_PROGRESS", 5)


@query("SELECT seq, run_id FROM (SELECT seq, run_id, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS n FROM log WHERE event_type IN ('RUN_COMPLETED', 'RUN_FAILED')) WHERE n = 1")
def str06_first_terminal(m: Model) -> DataFrame:
    return m.log.where(F.col("event_type").isin("RUN_COMPLETED", "RUN_FAILED")).groupBy("run_id").agg(F.min("seq").alias("seq"))


ROLLED = "rolled AS (SELECT DISTINCT run_id FROM log WHERE event_type = 'RUN_FAILED' AND value > 90)"


@query(f"WITH {ROLLED} SELECT seq, run_id, event_type FROM log l WHERE event_type IN ('RUN_QUEUED', 'RUN_COMPLETED') OR (event_type = 'RUN_RUNNING' AND NOT EXISTS (SELECT 1 FROM rolled r WHERE r.run_id = l.run_id))")
def rep02_rollback_skip(m: Model) -> DataFrame:
    log = m.log.select("seq", "run_id", "event_type", "value")
    rolled = log.where("event_type = 'RUN_FAILED' and value > 90").select("run_id")
    local = log.where("event_type = 'RUN_RUNNING'").join(rolled, "run_id", "left_anti")
    return log.where(F.col("event_type").isin("RUN_QUEUED", "RUN_COMPLETED")).unionByName(local).select("seq", "run_id", "event_type")


@query("""SELECT DISTINCT a.seq FROM log a JOIN log b ON a.family_id = b.family_id AND b.seq > a.seq AND b.run_id <> a.run_id WHERE a.event_type = 'RUN_COMPLETED' AND b.event_type = 'RUN_FAILED'""")
def rb02_interference(m: Model) -> DataFrame:
    log = m.log
    late = log.where("event_type = 'RUN_FAILED'").groupBy("family_id", "run_id").agg(F.max("seq").alias("s"))
    top = late.groupBy("family_id").agg(F.max(F.struct("s", "run_id")).alias("t1"))
    other = late.join(top, "family_id").where("run_id <> t1.run_id").groupBy("family_id").agg(F.max("s").alias("s2"))
    best = top.join(other, "family_id", "left").select("family_id", F.col("t1.run_id").alias("r1"), F.col("t1.s").alias("s1"), "s2")
    a = log.where("event_type = 'RUN_COMPLETED'").select("seq", "run_id", "family_id").join(best, "family_id")
    return a.where("(r1 <> run_id and s1 > seq) or (r1 = run_id and s2 > seq)").select("seq").distinct()


@query("""SELECT s.id AS source_id, count(*) AS run_count, min(e.observed_at) AS first_seen, max(e.observed_at) AS last_seen, arg_min(e.claim_id, (e.observed_at, e.claim_id, e.seq_in_claim)) AS first_claim FROM evidence e JOIN sources s ON e.source_id = s.id GROUP BY 1""")
def pj12_source_observed(m: Model) -> DataFrame:
    s = m.sources.select(F.col("id").alias("source_id"))
    g = m.evidence.groupBy("source_id").agg(
        F.count("*").alias("run_count"), F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"), F.min_by("claim_id", F.struct("observed_at", "claim_id", "seq_in_claim")).alias("first_claim"),
    )
    return g.join(s, "source_id", "left_semi")


@query("""SELECT run_id, arg_max(event_type, seq) FILTER (WHERE event_type <> 'RUN_PROGRESS') AS status, arg_max(value, seq) FILTER (WHERE event_type = 'RUN_PROGRESS') AS progress, arg_min(ts, seq) AS created_at FROM log GROUP BY 1""")
def pj_last_writer(m: Model) -> DataFrame:
    moved = F.col("event_type") == "RUN_PROGRESS"
    return m.log.groupBy("run_id").agg(
        F.max_by(F.when(~moved, F.col("event_type")), F.when(~moved, F.col("seq"))).alias("status"), F.max_by(F.when(moved, F.col("value")), F.when(moved, F.col("seq"))).alias("progress"), F.min_by("ts", "seq").alias("created_at"),
    )


@query("""WITH RECURSIVE m AS (SELECT o_orderkey AS a, o_orderkey - 3 AS b FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey > 3 UNION ALL SELECT o_orderkey, o_orderkey - 1 FROM orders WHERE o_orderkey % 7 = 4 AND o_orderkey > 1),
r AS (SELECT a, b FROM m UNION ALL SELECT r.a, m.b FROM r JOIN m ON r.b = m.a) SELECT a AS claim_id, min(b) AS survivor FROM r GROUP BY 1""")
def pj16_merge_chains(m: Model) -> DataFrame:
    k = F.col("o_orderkey")
    merged = m.orders.where(((k % 7 == 0) & (k > 3)) | ((k % 7 == 4) & (k > 1))).select(k.alias("a"), F.when(k % 7 == 0, k - 3).otherwise(k - 1).alias("b"))
    found = graph.components(merged)
    return merged.select(F.col("a").alias("id")).join(found, "id").select(F.col("id").alias("claim_id"), F.col("component").alias("survivor"))


@query("""SELECT 'evidence_without_claim' AS problem, count(*) AS n FROM evidence e WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE c.id = e.claim_id) UNION ALL SELECT 'claim_without_family', count(*) FROM claims c WHERE NOT EXISTS (SELECT 1 FROM families f WHERE f.id = c.family_id)
UNION ALL SELECT 'claim_without_evidence', count(*) FROM claims c WHERE NOT EXISTS (SELECT 1 FROM evidence e WHERE e.claim_id = c.id)""")
def chk04_integrity(m: Model) -> DataFrame:
    c, e, f = m.claims, m.evidence, m.families
    parts = [
        ("evidence_without_claim", e.join(c.select(F.col("id").alias("claim_id")), "claim_id", "left_anti")), ("claim_without_family", c.join(f.select(F.col("id").alias("family_id")), "family_id", "left_anti")),
        ("claim_without_evidence", c.join(e.select(F.col("claim_id").alias("id")), "id", "left_anti")),
    ]
    out = None
    for name, rows in parts:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT coalesce(a.id, e.id) AS id, CASE WHEN a.id IS NULL THEN 'missing' WHEN e.id IS NULL THEN 'unexpected' ELSE 'changed' END AS difference FROM (SELECT id, epistemic_status AS s FROM claims WHERE id % 5 <> 0) a
FULL OUTER JOIN (SELECT id, CASE WHEN id % 11 = 0 THEN 'x' ELSE epistemic_status END AS s FROM claims WHERE id % 7 <> 0) e ON a.id = e.id WHERE a.s IS DISTINCT FROM e.s""")
def se06_table_diff(m: Model) -> DataFrame:
    c = m.claims
    return evaluate.table_diff(c.where("id % 5 <> 0").select("id", F.col("epistemic_status").alias("s")), c.where("id % 7 <> 0").select("id", F.when(F.col("id") % 11 == 0, F.lit("x")).otherwise(F.col("epistemic_status")).alias("s")), "id")


LABELS = "p AS (SELECT CAST(quality AS STRING) AS expected, CAST(1 - toxic AS STRING) AS actual FROM labels)"


def _labels(m: Model) -> DataFrame:
    return m.labels.select(F.col("quality").cast("string").alias("expected"), (1 - F.col("toxic")).cast("string").alias("actual"))


@query(f"WITH {LABELS} SELECT expected, actual, count(*) AS n FROM p GROUP BY 1, 2")
def ag21_confusion(m: Model) -> DataFrame:
    return evaluate.confusion(_labels(m))


@query(f"""WITH {LABELS}, l AS (SELECT expected AS label FROM p UNION SELECT actual FROM p), s AS (SELECT label, (SELECT count(*) FROM p WHERE expected = label AND actual = label) AS tp, (SELECT count(*) FROM p WHERE expected = label) AS w, (SELECT count(*) FROM p WHERE actual = label) AS g FROM l),
r AS (SELECT *, CASE WHEN g = 0 THEN 0 ELSE tp / g::DOUBLE END AS pr, CASE WHEN w = 0 THEN 0 ELSE tp / w::DOUBLE END AS re FROM s)
SELECT label, round(pr::DOUBLE, 6) AS precision, round(re::DOUBLE, 6) AS recall, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END::DOUBLE, 6) AS f1, w AS support FROM r""")
def ag22_per_class(m: Model) -> DataFrame:
    return evaluate.per_class(_labels(m))


@query("""WITH x AS (SELECT vec_id % 13 AS pred, label AS gold FROM embeddings), y AS (SELECT count(*) OVER (PARTITION BY pred, gold) / count(*) OVER (PARTITION BY pred)::DOUBLE AS p, count(*) OVER (PARTITION BY pred, gold) / count(*) OVER (PARTITION BY gold)::DOUBLE AS r FROM x)
SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(2 * avg(p) * avg(r) / (avg(p) + avg(r)), 6) AS f1 FROM y""")
def ag24_b_cubed(m: Model) -> DataFrame:
    return evaluate.b_cubed(m.embeddings.select((F.col("vec_id") % 13).alias("pred"), F.col("label").alias("gold")))


@query("SELECT event_type, median(value) AS p50, list_sort(list(value))[CAST(ceil(0.95 * count(*)) AS INT)] AS p95 FROM events GROUP BY 1")
def ag25_median_p95(m: Model) -> DataFrame:
    w = Window.partitionBy("event_type")
    ranked = m.events.select("event_type", "value", F.row_number().over(w.orderBy("value")).alias("k"), F.count("*").over(w).alias("n"))
    p95 = ranked.where(F.col("k") == F.ceil(F.col("n") * 0.95)).select("event_type", F.col("value").alias("p95"))
    return m.events.groupBy("event_type").agg(F.percentile("value", 0.5).alias("p50")).join(p95, "event_type")


@query("""SELECT id FROM (SELECT id, row_number() OVER (ORDER BY quality, id) AS n, count(*) OVER () AS total FROM sources WHERE NOT (extraction_status = 'failed' AND id % 2 = 0)) WHERE n > greatest(total - 70, 0)""")
def pg08_evict_sources(m: Model) -> DataFrame:
    rows = m.sources.where(~((F.col("extraction_status") == "failed") & (F.col("id") % 2 == 0)))
    return rows.orderBy(F.col("quality").desc(), F.col("id").desc()).limit(70).select("id")


@query(f"""WITH s AS (SELECT p_partkey AS id, p_brand AS q, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS t FROM part)
SELECT a.id AS a, b.id AS b, a.q = b.q AS shared FROM s a JOIN s b ON a.id < b.id AND (a.q = b.q OR len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE > 0.35) WHERE a.id % 50 = 0""")
def jn13_related_claims(m: Model) -> DataFrame:
    """Every fiftieth finding with all later ones of its question or alike in words."""
    rows = m.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("question"), F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("tokens"))
    return graph.related(rows.where("id % 50 = 0"), rows, 0.35)
