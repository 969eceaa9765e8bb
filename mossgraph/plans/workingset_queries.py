"""The state of research runs over the driver's tables: orders are findings, suppliers sources, customers runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate, graph, readmodel, workingset
from .model import Model
from .registry import query
from .wording_queries import pick, pick_sql


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n, row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= 500 AS accepted FROM orders")
def rs01_admitted(m: Model) -> DataFrame:
    """Entries in order of arrival; 500 is the capacity of a standard run."""
    cap = workingset.PROFILES["standard"][-1]
    return workingset.admitted(m.orders.select(F.col("o_orderkey").alias("id"), "o_orderdate"), cap, "o_orderdate", "id").select("id", "n", "accepted")


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey % 7 = 3 OR o_orderkey % 11 = 3")
def rs02_of_question(m: Model) -> DataFrame:
    rows = m.orders.select(F.col("o_orderkey").alias("id"), F.array(F.col("o_custkey") % 7, F.col("o_orderkey") % 11).alias("questions"))
    return workingset.of_question(rows, 3).select("id")


@query("""SELECT s_suppkey AS id, coalesce(v, 'pending') AS status FROM supplier LEFT JOIN (SELECT l_suppkey AS k, arg_max(l_returnflag || l_linestatus, l_orderkey * 10 + l_linenumber + l_partkey / 1000000.0) AS v FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1) ON k = s_suppkey""")
def rs03_overlaid_status(m: Model) -> DataFrame:
    updates = m.lineitem.where("l_suppkey % 3 = 0").select(F.col("l_suppkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber") + F.col("l_partkey") / 1000000.0).alias("ord"), F.concat("l_returnflag", "l_linestatus").alias("value"))
    return workingset.overlay(m.supplier.select(F.col("s_suppkey").alias("id"), F.lit("pending").alias("status")), updates, "id", "status")


@query("SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS gap FROM orders WHERE (o_orderkey % 2 = 0 AND o_orderkey % 4 < 4 AND o_custkey % 3 < 2) OR (o_orderkey % 2 = 1 AND o_custkey % 3 = 0)")
def rs04_open_records(m: Model) -> DataFrame:
    k = F.col("o_custkey") % 3
    gaps = m.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.when(k == 0, F.lit("open")).when(k == 1, F.lit("in_progress")).otherwise(F.lit("resolved")).alias("status"))
    disputes = m.orders.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("id"), F.when(k == 0, F.lit("unresolved")).otherwise(F.lit("resolved")).alias("status"))
    return workingset.open_gaps(gaps).select("id", F.lit(True).alias("gap")).union(workingset.unresolved(disputes).select("id", F.lit(False)))


@query("SELECT item_id AS run_id, CAST(n AS INT) AS n, md5(string_split(text, ' ')[n + 1]) AS question FROM (SELECT item_id, text, unnest(range(least(len(string_split(text, ' ')), 4))) AS n FROM benchmark)")
def rs07_truncated_questions(m: Model) -> DataFrame:
    rows = workingset.truncated_questions(m.benchmark.select(F.col("item_id").alias("run_id"), F.split("text", " ").alias("questions")), 4)
    return rows.select("run_id", "n", F.md5(F.col("question").cast("binary")).alias("question"))


@query("SELECT run_id, seq FROM (SELECT run_id, seq, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS n FROM log) WHERE n <= 50")
def rs08_diary(m: Model) -> DataFrame:
    return workingset.diary(m.log.select("run_id", F.col("seq").alias("ord"))).select("run_id", F.col("ord").alias("seq"))


@query("SELECT c_custkey AS run_id, count(o_orderkey) AS findings, count(DISTINCT o_orderpriority) AS kinds FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def rs09_counters(m: Model) -> DataFrame:
    counts = m.orders.groupBy(F.col("o_custkey").alias("run_id")).agg(F.count("*").alias("findings"), F.size(F.collect_set("o_orderpriority")).cast("long").alias("kinds"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return m.customer.select(F.col("c_custkey").alias("run_id")).join(counts, "run_id", "left").select("run_id", zero("findings"), zero("kinds"))


@query("""SELECT c_custkey AS run_id, CASE c_custkey % 6 WHEN 0 THEN 35 WHEN 1 THEN 70 WHEN 2 THEN 140 WHEN 3 THEN 220 WHEN 4 THEN 100 ELSE 70 END AS max_sources, CASE WHEN c_custkey % 4 = 0 THEN 1000 ELSE CASE c_custkey % 6 WHEN 0 THEN 300000 WHEN 1 THEN 480000 WHEN 2 THEN 1800000 WHEN 3 THEN 2700000 WHEN 4 THEN 900000 ELSE 480000 END END AS max_time_ms,
greatest(0, CASE c_custkey % 6 WHEN 0 THEN 60 WHEN 1 THEN 200 WHEN 2 THEN 400 WHEN 3 THEN 800 WHEN 4 THEN 300 ELSE 200 END - c_custkey % 500) AS calls_left FROM customer""")
def rs10_budgets(m: Model) -> DataFrame:
    k = F.col("c_custkey")
    p = workingset.profile(pick(k, "quick", "standard", "deep", "exhaustive", "tree", "unknown"), F.when(k % 4 == 0, F.lit(1000)))
    return m.customer.select(k.alias("run_id"), p.alias("p")).select("run_id", "p.max_sources", "p.max_time_ms", workingset.remaining(F.col("p.max_tool_calls"), F.col("run_id") % 500).alias("calls_left"))


@query("SELECT o_custkey AS run_id, o_orderpriority AS step, round(sum(o_totalprice), 2) AS cost FROM orders GROUP BY 1, 2")
def rs10_step_costs(m: Model) -> DataFrame:
    costs = workingset.step_costs(m.orders.select(F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("step"), F.col("o_totalprice").alias("cost")))
    return costs.withColumn("cost", F.round("cost", 2))


@query("""WITH l AS (SELECT l_orderkey AS run_id, l_linenumber AS n, CAST(l_quantity AS INT) % 9 AS added FROM lineitem), u AS (SELECT run_id, n, max(added) AS added FROM l GROUP BY 1, 2), w AS (SELECT *, sum(added) OVER (PARTITION BY run_id) AS total, row_number() OVER (PARTITION BY run_id ORDER BY n DESC) AS back FROM u)
SELECT run_id, max(total) > 0 AND count(*) >= 2 AND count(*) FILTER (WHERE back <= 2 AND added >= total * 0.05) = 0 AS plateau FROM w GROUP BY 1""")
def wn07_plateau(m: Model) -> DataFrame:
    loops = m.lineitem.groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("n")).agg(F.max(F.col("l_quantity").cast("int") % 9).alias("added"))
    return workingset.plateau(loops)


@query("""WITH g AS (SELECT o_orderkey AS ord, o_orderpriority AS category, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS q, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS f FROM orders), k AS (SELECT *, category || '::' || coalesce(CAST(q AS STRING), '') || '::' || coalesce(CAST(f AS STRING), '') AS key FROM g)
SELECT min(ord) AS ord, arg_min(category, ord) AS category FROM k WHERE ord % 5 > 0 AND key NOT IN (SELECT key FROM k WHERE ord % 5 = 0 AND ord % 2 = 0) GROUP BY key""")
def ag14_new_gaps(m: Model) -> DataFrame:
    k = F.col("o_orderkey")
    rows = m.orders.select(k.alias("ord"), F.col("o_orderpriority").alias("category"), F.when(k % 3 > 0, F.col("o_custkey")).alias("question_id"), F.when(k % 3 == 0, F.col("o_custkey")).alias("finding_id"), F.when(k % 2 == 0, F.lit("open")).otherwise(F.lit("resolved")).alias("status"))
    return workingset.new_gaps(rows.where("ord % 5 > 0"), rows.where("ord % 5 = 0")).select("ord", "category")


@query("""WITH r AS (SELECT c_custkey AS run_id, c_custkey % 13 = 0 AS exhausted, c_custkey % 5 AS loops, 2 AS min_loops, c_custkey % 4 = 0 AS thin, 3 AS questions, c_custkey % 4 AS well, c_custkey % 7 AS open_gaps, c_custkey % 3 AS urgent, c_custkey % 11 = 0 AS later FROM customer)
SELECT run_id, CASE WHEN exhausted THEN false WHEN thin THEN true WHEN open_gaps = 0 THEN false WHEN loops < min_loops THEN true WHEN later THEN false WHEN urgent = 0 AND well / 3.0 > 0.5 AND loops >= questions THEN false WHEN urgent = 0 AND loops >= 2 AND well / 3.0 >= 0.3 THEN false ELSE true END AS goes_on FROM r""")
def ag15_continue_loop(m: Model) -> DataFrame:
    k = F.col("c_custkey")
    runs = m.customer.select(
        k.alias("run_id"), (k % 13 == 0).alias("exhausted"), (k % 5).alias("loops"), F.lit(2).alias("min_loops"), (k % 4 == 0).alias("thin"), F.lit(3).alias("questions"), (k % 4).alias("well_covered"), (k % 7).alias("open_gaps"), (k % 3).alias("urgent"), (k % 11 == 0).alias("later"),
    )
    return workingset.continue_loop(runs).select("run_id", "goes_on")


@query("""SELECT q AS question_id, count(DISTINCT s_suppkey) AS n_sources, count(DISTINCT s_nationkey) AS n_domains, count(DISTINCT s_suppkey % 3) AS n_types FROM (SELECT r_regionkey AS q FROM region) LEFT JOIN (SELECT *, unnest([s_suppkey % 4, s_nationkey % 4]) AS x FROM supplier) ON x = q GROUP BY 1""")
def jn10_question_membership(m: Model) -> DataFrame:
    sources = m.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("domain"), (F.col("s_suppkey") % 3).alias("source_type"), F.array(F.col("s_suppkey") % 4, F.col("s_nationkey").cast("long") % 4).alias("questions"))
    found = workingset.coverage(m.region.select(F.col("r_regionkey").alias("question_id")), sources)
    return found.select("question_id", *[F.col(c).cast("long").alias(c) for c in ("n_sources", "n_domains", "n_types")])


@query("SELECT count(DISTINCT o_orderkey) AS claims, (SELECT count(*) FROM lineitem) AS evidence, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS sources FROM orders")
def ag19_completion_counters(m: Model) -> DataFrame:
    told = m.lineitem.agg(F.count("*").alias("evidence"), F.countDistinct("l_suppkey").alias("sources"))
    return m.orders.agg(F.countDistinct("o_orderkey").alias("claims")).join(told)


LABELS = """p AS (SELECT o_orderkey AS id, CASE o_custkey % 4 WHEN 0 THEN 'same_claim' WHEN 1 THEN 'contradiction' WHEN 2 THEN 'elaboration' ELSE 'new_claim' END AS gold, CASE o_orderkey % 4 WHEN 0 THEN 'same_claim' WHEN 1 THEN 'contradiction' WHEN 2 THEN 'elaboration' ELSE 'new_claim' END AS got, o_custkey % 10 AS gm, o_orderkey % 10 AS pm FROM orders)"""


@query(f"""WITH {LABELS} SELECT round(avg(CASE WHEN gold <> 'new_claim' THEN CAST(gm = pm AND got <> 'new_claim' AS INT) END), 6) AS matched_top1, round(avg(CASE WHEN gold = 'same_claim' THEN CAST(got = 'same_claim' AND gm = pm AS INT) END), 6) AS reuse_accuracy,
round(avg(CAST((gold = 'new_claim') = (got = 'new_claim') AS INT)), 6) AS related_vs_reject, round(count(*) FILTER (WHERE gold = 'new_claim' AND got = 'new_claim') / count(*) FILTER (WHERE got = 'new_claim'), 6) AS reject_precision,
round(count(*) FILTER (WHERE gold = 'new_claim' AND got = 'new_claim') / count(*) FILTER (WHERE gold = 'new_claim'), 6) AS reject_recall, round(avg(CASE WHEN gold = 'new_claim' THEN CAST(got <> 'new_claim' AS INT) END), 6) AS false_link_rate FROM p""")
def ag23_linking_metrics(m: Model) -> DataFrame:
    names = ("same_claim", "contradiction", "elaboration", "new_claim")
    rows = m.orders.select(pick(F.col("o_custkey"), *names).alias("gold"), pick(F.col("o_orderkey"), *names).alias("predicted"), (F.col("o_custkey") % 10).alias("gold_match"), (F.col("o_orderkey") % 10).alias("predicted_match"))
    return evaluate.linking_metrics(rows)


@query("SELECT c_nationkey AS check_group, CASE max(CASE WHEN c_acctbal < 0 THEN 2 WHEN c_acctbal < 500 THEN 1 ELSE 0 END) WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'ok' END AS severity FROM customer GROUP BY 1")
def ag26_worst_severity(m: Model) -> DataFrame:
    severity = F.when(F.col("c_acctbal") < 0, F.lit("error")).when(F.col("c_acctbal") < 500, F.lit("warning")).otherwise(F.lit("ok"))
    return evaluate.worst_by(m.customer.select(F.col("c_nationkey").alias("check_group"), severity.alias("severity")), "check_group")


@query("SELECT id, question_id, place FROM (SELECT o_orderkey AS id, q AS question_id, row_number() OVER (PARTITION BY q ORDER BY o_orderkey) AS place FROM (SELECT o_orderkey, unnest([o_custkey % 50, 50 + o_orderkey % 30]) AS q FROM orders)) WHERE place <= 5")
def ag27_findings_by_question(m: Model) -> DataFrame:
    rows = m.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("claim"), F.array(F.col("o_custkey") % 50, F.lit(50) + F.col("o_orderkey") % 30).alias("questions"))
    return workingset.findings_by_question(rows).select("id", "question_id", "place")


@query("""WITH f AS (SELECT o_custkey AS r, count(*) AS n, count(DISTINCT o_orderkey % 5) AS c FROM orders GROUP BY 1), x AS (SELECT l_suppkey AS r, count(*) AS o FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
SELECT c_custkey AS run_id, CASE WHEN n IS NULL THEN '[Source-note synthesis only] No findings extracted during this research run.' ELSE 'This research found ' || CAST(n AS STRING) || ' claims covering ' || CAST(c AS STRING) || ' of 1 research questions.' ||
 CASE WHEN o > 0 THEN ' ' || CAST(o AS STRING) || ' unresolved ' || CASE WHEN o = 1 THEN 'contradiction was' ELSE 'contradictions were' END || ' identified between sources.' ELSE '' END END AS summary FROM customer LEFT JOIN f ON f.r = c_custkey LEFT JOIN x ON x.r = c_custkey""")
def ag28_executive_summary(m: Model) -> DataFrame:
    findings = m.orders.select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("id"), F.array(F.col("o_orderkey") % 5).alias("questions"))
    disputes = m.lineitem.select(F.col("l_suppkey").alias("run_id"), F.when(F.col("l_quantity") > 45, F.lit("unresolved")).otherwise(F.lit("resolved")).alias("status"))
    return workingset.executive_summary(findings, m.customer.select(F.col("c_custkey").alias("run_id")), disputes)


@query("""WITH x AS (SELECT a.o_orderkey AS id, a.o_totalprice AS old, b.o_totalprice AS new FROM orders a LEFT JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 AND b.o_custkey % 3 = 0) SELECT id, md5(CAST(CAST(floor(old) AS INT) AS STRING)) AS old_hash, md5(CAST(CAST(floor(new) AS INT) AS STRING)) AS new_hash FROM x WHERE new IS NOT NULL AND id % 4 > 0 AND floor(old) <> floor(new)""")
def jn20_hash_changes(m: Model) -> DataFrame:
    h = F.md5(F.floor("o_totalprice").cast("int").cast("string").cast("binary"))
    old = m.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 > 0, h).alias("hash"))
    new = m.orders.where("o_custkey % 3 = 0").select((F.col("o_orderkey") - 1).alias("id"), h.alias("hash"))
    return readmodel.hash_changes(old, new)


@query("""SELECT o_orderkey AS id, o_totalprice AS value FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 250""")
def pg04_drained(m: Model) -> DataFrame:
    """Pages of 100 until 250 rows are there; the same as one bounded query."""
    return readmodel.drained(m.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value")), 250, "value").select("id", "value")


@query("""WITH q AS (SELECT run_id, min(seq) AS seq, min(family_id) AS family_id, arg_max(event_type, seq) AS last FROM log GROUP BY 1) SELECT run_id, seq, family_id, last FROM q WHERE last <> 'RUN_PROGRESS' AND family_id IN (1, 2, 3, 4, 5) AND seq < 100000 ORDER BY seq DESC LIMIT 30""")
def pg07_runs(m: Model) -> DataFrame:
    runs = m.log.groupBy("run_id").agg(F.min("seq").alias("seq"), F.min("family_id").alias("family_id"), F.max_by("event_type", "seq").alias("last"))
    return readmodel.run_page(runs.where("last <> 'RUN_PROGRESS' and family_id in (1, 2, 3, 4, 5)"), before=100000, limit=30)


@query("""WITH u AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_orderkey % 9 = 0), e AS (SELECT 0 AS st, 'source' AS kind, s_suppkey AS id, s_acctbal AS b FROM supplier WHERE s_suppkey NOT IN (SELECT id FROM u)
UNION ALL SELECT 1, 'finding', o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 9 = 0 GROUP BY 1 HAVING count(DISTINCT l_suppkey) < 2) UNION ALL SELECT 2, 'gap', p_partkey, p_size FROM part),
t AS (SELECT (SELECT count(*) FROM supplier) + (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey % 9 = 0) + (SELECT count(*) FROM part) AS n)
SELECT kind, id FROM (SELECT *, row_number() OVER (ORDER BY st, b, id) AS n FROM e) x, t WHERE x.n <= t.n - (SELECT count(*) FROM part)""")
def pg09_state_guard(m: Model) -> DataFrame:
    links = m.lineitem.where("l_orderkey % 9 = 0").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("sources"))
    findings = links.join(m.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("id"), "sources", F.col("o_totalprice").alias("confidence"))
    gaps = m.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("priority"))
    return workingset.guarded(m.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("rank")), findings, gaps, gaps.count())


@query("""SELECT id, row_number() OVER (ORDER BY CASE WHEN authority_class IN ('official_spec', 'official_changelog') THEN 0 WHEN authority_class IN ('official_repo', 'package_registry') THEN 1 ELSE 2 END, quality DESC, id) AS n FROM sources WHERE extraction_status <> 'failed'""")
def pg10_evidence_sources(m: Model) -> DataFrame:
    from ..functions.wording import source_tier

    tier = F.when(source_tier(F.col("authority_class")) == "primary", 0).when(source_tier(F.col("authority_class")) == "secondary", 1).otherwise(2)
    rows = m.sources.where("extraction_status <> 'failed'").select("id", tier.alias("tier"), "quality")
    return workingset.numbered(rows, "tier", F.col("quality").desc(), "id").select("id", "n")


@query("""WITH s AS (SELECT o_custkey AS source_id, o_orderkey AS id FROM orders WHERE o_orderkey % 13 > 0), r AS (SELECT o_custkey AS source_id, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS result, o_orderkey AS id FROM orders WHERE o_orderkey % 11 > 0)
SELECT c_custkey AS source_id, NOT EXISTS (SELECT id FROM s WHERE s.source_id = c_custkey EXCEPT SELECT id FROM r WHERE r.source_id = c_custkey) AND NOT EXISTS (SELECT id FROM r WHERE r.source_id = c_custkey EXCEPT SELECT id FROM s WHERE s.source_id = c_custkey) AS exact FROM customer WHERE c_custkey IN (SELECT source_id FROM s UNION SELECT source_id FROM r)""")
def se05_exact_partition(m: Model) -> DataFrame:
    members = m.orders.where("o_orderkey % 13 > 0").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("id"))
    results = m.orders.where("o_orderkey % 11 > 0").select(F.col("o_custkey").alias("source_id"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("a")).otherwise(F.lit("b")).alias("result"), F.col("o_orderkey").alias("id"))
    return evaluate.exact_partition(members, results)


@query("""SELECT 'claims' AS collection, coalesce(a.id, e.id) AS id, CASE WHEN a.id IS NULL THEN 'missing' WHEN e.id IS NULL THEN 'unexpected' ELSE 'changed' END AS difference FROM (SELECT id, polarity AS s FROM claims WHERE id % 6 <> 0) a FULL JOIN (SELECT id, CASE WHEN id % 10 = 0 THEN 'x' ELSE polarity END AS s FROM claims WHERE id % 8 <> 0) e ON a.id = e.id WHERE a.s IS DISTINCT FROM e.s
UNION ALL SELECT 'sources', coalesce(a.id, e.id), CASE WHEN a.id IS NULL THEN 'missing' WHEN e.id IS NULL THEN 'unexpected' ELSE 'changed' END FROM (SELECT id FROM sources WHERE id % 3 <> 0) a FULL JOIN (SELECT id FROM sources WHERE id % 4 <> 0) e ON a.id = e.id WHERE a.id IS NULL OR e.id IS NULL""")
def se07_golden_diff(m: Model) -> DataFrame:
    c, s = m.claims.select("id", "polarity"), m.sources.select("id", "title")
    actual = {"claims": c.where("id % 6 <> 0"), "sources": s.where("id % 3 <> 0")}
    golden = {"claims": c.where("id % 8 <> 0").withColumn("polarity", F.when(F.col("id") % 10 == 0, F.lit("x")).otherwise(F.col("polarity"))), "sources": s.where("id % 4 <> 0")}
    return evaluate.golden_diff(actual, golden, "id")


@query("""WITH e AS (SELECT p_partkey AS a, p_partkey + p_size AS b FROM part), rep AS (SELECT o_custkey AS cluster, arg_max(o_orderkey, o_totalprice * 1000000 - o_orderkey) AS claim FROM orders GROUP BY 1) SELECT x.claim AS from_claim, y.claim AS to_claim FROM e JOIN rep x ON x.cluster = e.a JOIN rep y ON y.cluster = e.b""")
def jn17_representative_edges(m: Model) -> DataFrame:
    clusters = m.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cluster"), F.col("o_totalprice").alias("confidence"))
    edges = m.part.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + F.col("p_size")).alias("b"))
    return graph.representative_edges(clusters, edges)


@query("""WITH c AS (SELECT p_name AS text, min(p_partkey) AS id FROM part GROUP BY 1) SELECT q.p_partkey AS contradiction, a.id AS claim_a, b.id AS claim_b FROM part q JOIN c a ON a.text = q.p_name JOIN c b ON b.text = CASE WHEN q.p_partkey % 2 = 0 THEN q.p_name ELSE 'no such claim' END""")
def jn18_claims_by_text(m: Model) -> DataFrame:
    told = m.part.select(F.col("p_partkey").alias("contradiction"), F.col("p_name").alias("text_a"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.lit("no such claim")).alias("text_b"))
    return graph.by_text(told, m.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")))


GAP_KINDS = ("unanswered_sub_question", "missing_recency", "single_source_dependency", "thin_coverage", "missing_source_type", "overrepresented_viewpoint")


@query(f"""WITH g AS (SELECT p_partkey AS id, {pick_sql('p_partkey', *GAP_KINDS)} AS category FROM part)
SELECT id, CASE category WHEN 'single_source_dependency' THEN 'academic' WHEN 'overrepresented_viewpoint' THEN CASE WHEN id % 4 = 1 THEN 'github' ELSE 'academic' END ELSE 'search' END AS method, CASE category WHEN 'missing_recency' THEN 'c' WHEN 'overrepresented_viewpoint' THEN 'o' ELSE 'q' END || CAST(id AS STRING) AS text,
 CASE WHEN category = 'missing_recency' THEN 'year' END AS freshness, CASE WHEN category = 'thin_coverage' THEN 15 ELSE 10 END AS limit FROM g WHERE category <> 'missing_source_type' AND NOT (category IN ('unanswered_sub_question', 'single_source_dependency', 'thin_coverage') AND id % 5 = 0)
UNION ALL SELECT id, m, 'o' || CAST(id AS STRING), NULL, 10 FROM g, (SELECT unnest(['academic', 'github']) AS m) WHERE category = 'missing_source_type' AND (m = 'academic' OR id % 4 = 0)""")
def al22_planned_searches(m: Model) -> DataFrame:
    k = F.col("p_partkey")
    name = lambda c: F.concat(F.lit(c), k.cast("string"))
    gaps = m.part.select(
        k.alias("id"), pick(k, *GAP_KINDS).alias("category"), F.when(k % 5 > 0, name("q")).alias("question"), name("c").alias("claim"), name("o").alias("query"),
        F.when(k % 4 == 0, F.array(F.lit("academic"), F.lit("github"), F.lit("reddit"))).otherwise(F.array(F.lit("academic"), F.lit("youtube"))).alias("missing"), F.when(k % 4 == 1, F.lit("academic")).otherwise(F.lit("web")).alias("dominant"),
    )
    return workingset.planned_searches(gaps, {"academic", "code"})


@query("""WITH f AS (SELECT o_orderkey AS id, o_custkey AS r, o_orderkey % 3 AS q FROM orders), s AS (SELECT l_orderkey AS id, l_suppkey AS src FROM lineitem GROUP BY 1, 2)
SELECT r AS run_id, q AS question_id, '## q' || CAST(q AS STRING) AS heading, md5(string_agg('- c' || CAST(id AS STRING), chr(10) ORDER BY id)) AS body, max(n) AS n_references FROM (SELECT f.*, (SELECT count(DISTINCT src) FROM f g JOIN s ON s.id = g.id WHERE g.r = f.r AND g.q = f.q AND src % 2 = 0) AS n FROM f) GROUP BY 1, 2""")
def al23_report_sections(m: Model) -> DataFrame:
    linked = m.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("sources"))
    findings = m.orders.join(linked, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("claim"), F.coalesce("sources", F.array().cast("array<long>")).alias("sources"), F.array(F.col("o_orderkey") % 3).alias("questions"))
    questions = m.customer.select(F.col("c_custkey").alias("run_id"), F.explode(F.array(*[F.lit(q).cast("long") for q in range(3)])).alias("question_id")).withColumn("question", F.concat(F.lit("q"), F.col("question_id").cast("string")))
    out = workingset.report_sections(findings, questions, m.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 2 == 0).alias("usable")))
    return out.withColumn("body", F.md5(F.col("body").cast("binary")))


@query("""WITH f AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 1 AND o_orderkey > 1 THEN o_orderkey - 1 ELSE o_orderkey END AS t, o_custkey % 9 AS a, o_custkey % 4 AS b FROM orders) SELECT t AS id, array_to_string(list_sort(list_distinct(list_concat(list(a), list(b)))), ',') AS sources, len(list_distinct(list(a % 3))) AS groundings FROM f GROUP BY 1""")
def al24_merged_findings(m: Model) -> DataFrame:
    k = F.col("o_orderkey")
    findings = m.orders.select(k.alias("id"), F.array(F.col("o_custkey") % 9, F.col("o_custkey") % 4).alias("sources"), F.array(k % 2).alias("questions"), F.array(F.struct((F.col("o_custkey") % 9 % 3).alias("source"), F.lit("p").alias("passage"), F.lit("s").alias("span"))).alias("groundings"))
    pairs = m.orders.where("o_orderkey % 5 = 1 and o_orderkey > 1").select((k - 1).alias("keep"), k.alias("absorb"))
    out = workingset.merged_findings(findings, pairs)
    return out.select("id", F.array_join(F.transform(F.array_sort("sources"), lambda x: x.cast("string")), ",").alias("sources"), F.size("groundings").alias("groundings"))


@query("""WITH s AS (SELECT l_orderkey AS id, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1), x AS (SELECT o_orderkey AS id, coalesce(n, 0) AS n, o_orderkey % 7 = 0 AS opposed, o_orderkey % 5 = 0 AS expires FROM orders LEFT JOIN s ON s.id = o_orderkey)
SELECT id, 'CLAIM_OBSERVED' AS event_type, 1 AS n FROM x UNION ALL SELECT id, 'EVIDENCE_LINKED', n * CASE WHEN opposed THEN 2 ELSE 1 END FROM x WHERE n > 0 UNION ALL SELECT id, 'CLAIM_EXPIRED', 1 FROM x WHERE expires""")
def al25_finding_events(m: Model) -> DataFrame:
    linked = m.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("sources"))
    k = F.col("o_orderkey")
    findings = m.orders.join(linked, k == F.col("l_orderkey"), "left").select(k.alias("id"), F.col("o_custkey").alias("run_id"), F.concat(F.lit("c"), k.cast("string")).alias("claim_id"), F.coalesce("sources", F.array().cast("array<long>")).alias("sources"), (k % 7 == 0).alias("opposed"), F.when(k % 5 == 0, k - 1).alias("expires"))
    return workingset.finding_events(findings).groupBy("id", "event_type").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT l_orderkey AS f, l_suppkey AS s, l_linenumber AS a, CAST(l_quantity AS INT) AS b, l_partkey FROM lineitem), d AS (SELECT f, count(DISTINCT s) AS n FROM g GROUP BY 1) SELECT g.f AS finding_id, s AS source_id, a AS start, CASE WHEN d.n > 1 AND g.f % 6 = 0 THEN 'sources' WHEN s % 4 = 0 THEN 'hash' WHEN a >= b THEN 'span' END AS problem FROM g JOIN d ON d.f = g.f""")
def al26_groundings(m: Model) -> DataFrame:
    w = m.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("all"))
    rows = m.lineitem.join(w, "l_orderkey").select(
        F.col("l_orderkey").alias("finding_id"), F.col("l_suppkey").alias("source_id"), F.when(F.col("l_orderkey") % 6 == 0, F.slice(F.array_sort("all"), 1, 1)).otherwise(F.col("all")).alias("declared"),
        F.when(F.col("l_suppkey") % 4 == 0, F.lit("stale")).otherwise(F.concat(F.lit("h"), F.col("l_suppkey").cast("string"))).alias("hash"), F.col("l_linenumber").alias("start"), F.col("l_quantity").cast("int").alias("end"),
    )
    return workingset.valid_groundings(rows, m.supplier.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("h"), F.col("s_suppkey").cast("string")).alias("hash")))


@query("""WITH p AS (SELECT l_orderkey AS id, l_linenumber AS n, max(l_discount) AS lex, max(CAST(l_quantity AS INT)) AS q FROM lineitem GROUP BY 1, 2), s AS (SELECT *, CASE WHEN id % 3 = 0 THEN q % 10 + 1 ELSE q % 11 + 1 END AS sc FROM p WHERE id % 4 > 0 OR n > 1), g AS (SELECT id, bool_and(sc BETWEEN 1 AND 10) AS ok, count(*) AS c FROM s GROUP BY 1), z AS (SELECT id, count(*) AS c FROM p GROUP BY 1),
b AS (SELECT p.id, p.n, round(CASE WHEN coalesce(ok AND g.c = z.c, false) THEN 0.7 * (sc - 1) / 9 + 0.3 * p.lex ELSE p.lex END, 6) AS blend, coalesce(ok AND g.c = z.c, false) AS judged FROM p JOIN z ON z.id = p.id LEFT JOIN g ON g.id = p.id LEFT JOIN s ON s.id = p.id AND s.n = p.n)
SELECT *, row_number() OVER (PARTITION BY id ORDER BY blend DESC, n) AS place FROM b""")
def al19_reranked(m: Model) -> DataFrame:
    lines = graph.gathered(m.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), "l_discount", "l_quantity"), m.lineitem.count(), "id")
    p = lines.groupBy("id", "n").agg(F.max("l_discount").cast("double").alias("lexical"), F.max(F.col("l_quantity").cast("int")).alias("q"))
    scores = p.where("id % 4 > 0 or n > 1").select("id", "n", F.when(F.col("id") % 3 == 0, F.col("q") % 10 + 1).otherwise(F.col("q") % 11 + 1).alias("score"))
    return workingset.reranked(p.drop("q"), scores)

