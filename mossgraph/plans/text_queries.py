"""Normalisers, similarities, addresses and hashes over the tables with text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import addresses, text, wording
from ..operators import cluster, graph, neighbours, ordered, reconcile, research
from .model import Model
from .registry import query

UNI = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\s]+', ' ', 'g'), '\s+', ' ', 'g'))"
STOP = "(" + ", ".join(f"'{w}'" for w in text.CLAIM_STOP_WORDS) + ")"
SCOPE_STOP = "(" + ", ".join(f"'{w}'" for w in text.SCOPE_STOP_WORDS) + ")"


@query(f"SELECT item_id, {UNI.format('text')} AS norm FROM benchmark")
def fn01_unicode_words(m: Model) -> DataFrame:
    return m.benchmark.select("item_id", text.unicode_words(F.col("text")).alias("norm"))


@query(r"SELECT conv_id, turn, role, md5(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS norm FROM conversations")
def fn02_ascii_words(m: Model) -> DataFrame:
    return m.conversations.select("conv_id", "turn", "role", F.md5(text.ascii_words(F.col("text")).cast("binary")).alias("norm"))


@query(rf"""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(trim(regexp_replace(regexp_replace(lower(p_name || ' for the ' || p_brand || '/x.1-'), '[^a-z0-9@._/\-\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda t: regexp_replace(t, '^[._/\-]+|[._/\-]+$', '', 'g')), lambda t: len(t) > 2 AND t NOT IN {STOP}))), ',') AS terms FROM part""")
def fn03_anchor_terms(m: Model) -> DataFrame:
    terms = text.anchor_terms(F.concat(F.col("p_name"), F.lit(" for the "), F.col("p_brand"), F.lit("/x.1-")))
    return m.part.select("p_partkey", F.array_join(F.array_sort(terms), ",").alias("terms"))


@query(rf"""SELECT p_partkey, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(p_type || ' of which through ' || p_brand || '-a nor very'), '[^a-z0-9\s\-]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda t: len(t) > 1 AND t NOT IN {SCOPE_STOP}), ',') AS tokens FROM part""")
def fn05_scope_tokens(m: Model) -> DataFrame:
    return m.part.select("p_partkey", F.array_join(text.scope_tokens(F.concat(F.col("p_type"), F.lit(" of which through "), F.col("p_brand"), F.lit("-a nor very"))), ",").alias("tokens"))


PAIR = """p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, list_distinct(string_split(lower(a.p_name || ' ' || a.p_type), ' ')) AS x, list_distinct(string_split(lower(b.p_name || ' ' || b.p_brand), ' ')) AS y
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"""


def _pairs(m: Model) -> DataFrame:
    a = m.part.select(F.col("p_partkey").alias("a"), F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("x"))
    b = m.part.select((F.col("p_partkey") - 1).alias("a"), F.col("p_partkey").alias("b"), F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_brand")), " ")).alias("y"))
    return a.join(b, "a")


@query(f"WITH {PAIR} SELECT a, b, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE, 6) AS score FROM p")
def fn08_jaccard(m: Model) -> DataFrame:
    return _pairs(m).select("a", "b", F.round(text.jaccard(F.col("x"), F.col("y"), 1.0), 6).alias("score"))


@query(f"WITH {PAIR} SELECT a, b, round(len(list_intersect(x, y)) / least(len(x), len(y))::DOUBLE, 6) AS score FROM p")
def fn10_overlap(m: Model) -> DataFrame:
    return _pairs(m).select("a", "b", F.round(text.overlap(F.col("x"), F.col("y")), 6).alias("score"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def fn11_cosine(m: Model) -> DataFrame:
    a, b = m.embeddings.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), m.embeddings.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, "a").select("a", "b", F.round(text.cosine(F.col("x"), F.col("y")), 5).alias("score"))


@query(r"""SELECT s_suppkey, array_to_string(list_sort(list_distinct(list_transform(list_concat(list_concat(regexp_extract_all(t, '(?i)@[a-z0-9][\w.-]*/[a-z0-9][\w.-]*'), regexp_extract_all(t, '(?i)\bv?\d+(?:\.\d+)*(?:-[\w.]+)?\b')), regexp_extract_all(t, '\b\d{4}-\d{2}-\d{2}\b')), lambda x: lower(x)))), ',') AS anchors
FROM (SELECT s_suppkey, '@Org/pkg.' || s_suppkey || ' V' || (s_suppkey % 7) || '.2 since 2024-01-1' || (s_suppkey % 9) || ' ' || s_name AS t FROM supplier)""")
def fn12_anchors(m: Model) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    t = F.concat(F.lit("@Org/pkg."), key, F.lit(" V"), (F.col("s_suppkey") % 7).cast("string"), F.lit(".2 since 2024-01-1"), (F.col("s_suppkey") % 9).cast("string"), F.lit(" "), F.col("s_name"))
    return m.supplier.select("s_suppkey", F.array_join(F.array_sort(text.anchors(t)), ",").alias("anchors"))


@query(rf"SELECT a.p_partkey, regexp_matches(a.p_name || ' is not removed', '{text.DENIAL}') AND regexp_matches(b.p_type || CASE WHEN b.p_partkey % 2 = 0 THEN ' adds' ELSE ' x' END, '{text.ASSERTION}') OR regexp_matches(b.p_type || CASE WHEN b.p_partkey % 2 = 0 THEN ' adds' ELSE ' x' END, '{text.DENIAL}') AND regexp_matches(a.p_name || ' is not removed', '{text.ASSERTION}') AS signal FROM part a JOIN part b ON a.p_partkey = b.p_partkey".replace("can't", "can''t"))
def fn14_contradiction_signal(m: Model) -> DataFrame:
    right = F.concat(F.col("p_type"), F.when(F.col("p_partkey") % 2 == 0, F.lit(" adds")).otherwise(F.lit(" x")))
    return m.part.select("p_partkey", text.contradiction_signal(F.concat(F.col("p_name"), F.lit(" is not removed")), right).alias("signal"))


@query("SELECT o_orderkey, CAST(ceil(len(o_orderpriority) / 4.0) AS BIGINT) AS estimate, CAST(least(1000 * pow(2, o_orderkey % 8), 30000) AS BIGINT) AS backoff FROM orders")
def fn42_estimates(m: Model) -> DataFrame:
    return m.orders.select("o_orderkey", wording.token_estimate(F.col("o_orderpriority")).alias("estimate"), wording.backoff(F.col("o_orderkey") % 8).alias("backoff"))


@query("SELECT event_id, sha256(props) AS payload_hash FROM events")
def fn19_payload_hash(m: Model) -> DataFrame:
    return m.events.select("event_id", F.sha2(F.col("props").cast("binary"), 256).alias("payload_hash"))


@query("""WITH RECURSIVE h AS (SELECT n_nationkey, n_name, 1 AS i, CAST(5381 AS BIGINT) AS v FROM nation UNION ALL SELECT n_nationkey, n_name, i + 1, (v * 33 + ascii(substr(n_name, i, 1))) % 4294967296 FROM h WHERE i <= len(n_name))
SELECT n_nationkey, 'djb2:' || lower(to_hex(v)) AS hash FROM h WHERE i = len(n_name) + 1""")
def fn18_djb2(m: Model) -> DataFrame:
    return m.nation.select("n_nationkey", text.djb2(F.col("n_name")).alias("hash"))


HOST = r"regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^(?i)https?://([^/?#]+)', 1)), '^[^@]*@', ''), ':[0-9]+$', ''), '^www\.', '')"


@query(f"SELECT page_id, {HOST} AS host FROM pages")
def fn22_host(m: Model) -> DataFrame:
    return m.pages.select("page_id", addresses.host_of(F.col("url")).alias("host"))


TRACK = "(" + ", ".join(f"'{w}'" for w in addresses.TRACKING) + ")"


@query(rf"""WITH x AS (SELECT page_id, trim(url) AS url, lower(regexp_extract(url, '^(?i)(https?)://', 1)) AS scheme, lower(regexp_extract(url, '^(?i)https?://([^/?#]+)', 1)) AS host,
 regexp_extract(url, '^(?i)https?://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
y AS (SELECT *, array_to_string(list_sort(list_filter(string_split(q, '&'), lambda p: p <> '' AND regexp_replace(p, '=.*$', '') NOT IN {TRACK})), '&') AS qq FROM x)
SELECT page_id, CASE WHEN host = '' THEN url ELSE scheme || '://' || host || CASE WHEN qq = '' THEN CASE WHEN path = '/' THEN '' ELSE path END ELSE CASE WHEN path = '' THEN '/' ELSE path END || '?' || qq END END AS canonical FROM y""")
def fn20_canonical_url(m: Model) -> DataFrame:
    return m.pages.select("page_id", addresses.canonical_url(F.col("url")).alias("canonical"))


@query(rf"SELECT page_id, strlen(url) <= 8192 AND regexp_matches(url, '^(?i)https?://[^/?#@]+') AND NOT regexp_matches({HOST}, '^([0-9.]+|localhost|.*\.localhost)$') AS ok FROM pages")
def flt11_fetchable(m: Model) -> DataFrame:
    return m.pages.select("page_id", addresses.fetchable(F.col("url")).alias("ok"))


@query(f"""SELECT page_id, CASE WHEN {HOST} = 'github.com' AND regexp_matches(url, '^(?i)https?://[^/]+/+(nodejs|microsoft|denoland|anthropics)/+[^/?#]+') THEN 'official_repo' WHEN {HOST} = 'github.com' AND regexp_matches(url, '^(?i)https?://[^/]+/+[^/?#]+/+[^/?#]+') THEN 'third_party_analysis' WHEN {HOST} = 'wikipedia.org' OR {HOST} LIKE '%.wikipedia.org' THEN 'encyclopedia' WHEN {HOST} IN ('npmjs.com', 'pypi.org', 'crates.io', 'rubygems.org') THEN 'package_registry'
 WHEN page_id % 4 = 0 THEN 'news' WHEN page_id % 4 = 1 THEN 'official_spec' WHEN page_id % 4 = 2 THEN 'forum_social' ELSE 'third_party_analysis' END AS authority_class FROM pages""")
def fn23_authority(m: Model) -> DataFrame:
    kind = F.when(F.col("page_id") % 4 == 0, F.lit("news")).when(F.col("page_id") % 4 == 1, F.lit("official_docs")).when(F.col("page_id") % 4 == 2, F.lit("reddit")).otherwise(F.lit("academic"))
    return m.pages.select("page_id", addresses.authority_of(F.col("url"), kind).alias("authority_class"))


@query(rf"""WITH x AS (SELECT page_id, lower(regexp_extract(url, '^(?i)(https?)://', 1)) AS scheme, lower(regexp_extract(url, '^(?i)https?://([^/?#]+)', 1)) AS host, regexp_extract(url, '^(?i)https?://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
y AS (SELECT *, array_to_string(list_sort(list_filter(string_split(q, '&'), lambda p: p <> '' AND regexp_replace(p, '=.*$', '') NOT IN {TRACK})), '&') AS qq FROM x),
z AS (SELECT page_id, scheme || '://' || host || CASE WHEN qq = '' THEN CASE WHEN path = '/' THEN '' ELSE path END ELSE CASE WHEN path = '' THEN '/' ELSE path END || '?' || qq END AS canonical FROM y)
SELECT canonical, page_id FROM (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY page_id % 2, page_id) AS n FROM z) WHERE n = 1""")
def ag20_dedup_sources(m: Model) -> DataFrame:
    rows = m.pages.select("page_id", addresses.canonical_url(F.col("url")).alias("canonical"))
    return research.best_of_each(rows, "canonical", "page_id", F.struct((F.col("page_id") % 2), F.col("page_id")))


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_size > b.p_size AS newer FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def fn29_newer_version(m: Model) -> DataFrame:
    a = m.part.select(F.col("p_partkey").alias("a"), F.concat(F.lit("v1."), F.col("p_size").cast("string")).alias("x"))
    b = m.part.select((F.col("p_partkey") - 1).alias("a"), F.col("p_partkey").alias("b"), F.concat(F.lit("1."), F.col("p_size").cast("string"), F.lit(".0")).alias("y"))
    return a.join(b, "a").select("a", "b", text.newer_version(F.col("x"), F.col("y")).alias("newer"))


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b, CASE WHEN a.p_brand <> b.p_brand THEN false ELSE abs(a.p_retailprice - b.p_retailprice) / greatest(abs(a.p_retailprice), abs(b.p_retailprice), 1) <= 0.1 END AS agree
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def fn28_numbers_agree(m: Model) -> DataFrame:
    a = m.part.select(F.col("p_partkey").alias("a"), F.col("p_retailprice").alias("v"), F.col("p_brand").alias("u"))
    b = m.part.select((F.col("p_partkey") - 1).alias("a"), F.col("p_partkey").alias("b"), F.col("p_retailprice").alias("w"), F.col("p_brand").alias("x"))
    return a.join(b, "a").select("a", "b", text.numbers_agree(F.col("v"), F.col("u"), F.col("w"), F.col("x")).alias("agree"))


#: Turns as findings, some of them said once more with other words behind them: near copies of both polarities.
SETS = r"""s AS (SELECT id, block, list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' '), lambda t: t <> '')) AS t FROM (
 SELECT conv_id * 1000 + turn * 10 AS id, role AS block, text FROM conversations WHERE text IS NOT NULL UNION ALL SELECT conv_id * 1000 + turn * 10 + 2, role, text || ' indeed' FROM conversations WHERE text IS NOT NULL AND turn % 3 = 0
 UNION ALL SELECT conv_id * 1000 + turn * 10 + 1, role, text || ' on the other hand maybe not' FROM conversations WHERE text IS NOT NULL AND turn % 2 = 1))"""


def _findings(m: Model) -> DataFrame:
    rows, n = m.conversations.where("text is not null"), F.col("conv_id") * 1000 + F.col("turn") * 10
    said = rows.select(n.alias("id"), "role", "text").union(rows.where("turn % 3 = 0").select(n + 2, "role", F.concat("text", F.lit(" indeed")))).union(rows.where("turn % 2 = 1").select(n + 1, "role", F.concat("text", F.lit(" on the other hand maybe not"))))
    return said.select("id", F.col("role").alias("block"), text.plain_tokens(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("tokens"))


@query(f"""WITH {SETS} SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE, 6) AS score FROM s a JOIN s b ON a.block = b.block AND a.id < b.id AND len(a.t) > 0 AND len(b.t) > 0
WHERE round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE, 6) >= 0.58""")
def jn11_similar_pairs(m: Model) -> DataFrame:
    return graph.similar_pairs(_findings(m), 0.58, ["block"])


@query(f"""WITH RECURSIVE {SETS}, e AS (SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.block = b.block AND a.id % 2 = b.id % 2 AND a.id <> b.id AND len(a.t) > 0 AND len(b.t) > 0
WHERE round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE, 6) >= 0.92), r AS (SELECT id AS a, id AS b FROM s UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS id, min(b) AS cluster FROM r GROUP BY a""")
def al05_finding_clusters(m: Model) -> DataFrame:
    return graph.linked_findings(_findings(m).withColumn("positive", F.col("id") % 2 == 0), ["block"]).select("id", "cluster")


ASSERTIONS = r"""x AS (SELECT p_partkey AS id, p_brand AS family_id, p_name AS subject, p_type AS predicate, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' ' || p_type END AS object,
 CASE p_partkey % 7 WHEN 0 THEN 'negative' WHEN 1 THEN 'conditional' ELSE 'positive' END AS polarity, CASE p_partkey % 2 WHEN 0 THEN 'certain' ELSE 'likely' END AS hedge,
 CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS value, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'kg' END AS unit FROM part)"""


def _assertions(m: Model) -> DataFrame:
    k = F.col("p_partkey")
    none = F.lit(None).cast("string")
    return m.part.select(
        k.alias("id"), F.col("p_brand").alias("family_id"), F.col("p_name").alias("subject"), F.col("p_type").alias("predicate"), F.when(k % 3 == 0, F.concat_ws(" ", "p_name", "p_type")).alias("object"),
        F.when(k % 7 == 0, F.lit("negative")).when(k % 7 == 1, F.lit("conditional")).otherwise(F.lit("positive")).alias("polarity"), F.when(k % 2 == 0, F.lit("certain")).otherwise(F.lit("likely")).alias("hedge"),
        F.when(k % 4 != 0, F.col("p_size").cast("double")).alias("value"), F.when(k % 4 != 0, F.lit("kg")).alias("unit"), none.alias("event_date"), none.alias("version"), none.alias("entity_id"),
    )


W = r"list_distinct(list_filter(string_split({0}, ' '), lambda t: t <> ''))"
RECON = rf"""WITH {ASSERTIONS}, n AS (SELECT *, {UNI.format('subject')} AS ns, {UNI.format('predicate')} AS np, {UNI.format("coalesce(object, '')")} AS nobj,
 {UNI.format("subject || ' ' || predicate || ' ' || coalesce(object, '')")} AS nt FROM x),
p AS (SELECT o.id AS oid, c.id AS cid, o.polarity AS op, c.polarity AS cp, o.hedge AS oh, c.hedge AS ch, o.nobj AS oo, c.nobj AS co, o.nt AS ot, o.ns = c.ns AND o.np = c.np AS head,
 coalesce(CAST(o.value AS STRING) || '_' || o.unit, '') = coalesce(CAST(c.value AS STRING) || '_' || c.unit, '') AS eqq,
 CASE WHEN o.value IS NULL OR c.value IS NULL THEN NULL ELSE abs(o.value - c.value) / greatest(abs(o.value), abs(c.value), 1) <= 0.1 END AS num,
 len(list_intersect({W.format('o.nt')}, {W.format('c.nt')})) / len(list_distinct(list_concat({W.format('o.nt')}, {W.format('c.nt')})))::DOUBLE AS jac,
 CASE WHEN o.nobj = '' OR c.nobj = '' THEN 1.0 ELSE len(list_intersect({W.format('o.nobj')}, {W.format('c.nobj')})) / len(list_distinct(list_concat({W.format('o.nobj')}, {W.format('c.nobj')})))::DOUBLE END AS ojac
 FROM n o JOIN n c ON o.family_id = c.family_id WHERE o.id % 50 = 0 AND c.id <> o.id),
s AS (SELECT *, head AND eqq AND oo = co AS keyed, head AND ojac >= 0.3 AS scoped FROM p),
t AS (SELECT *, round(CASE WHEN keyed AND op = cp AND coalesce(num, true) THEN 1.0 ELSE greatest(0, least(1, jac * 0.7 + CASE WHEN num IS NULL THEN 0.5 WHEN num THEN 1.0 ELSE 0.0 END * 0.15 + CASE WHEN op = cp THEN 0.1 ELSE 0 END + CASE WHEN oh = ch THEN 0.05 ELSE 0 END)) END::DOUBLE, 6) AS score FROM s),
"""


@query(RECON + "z AS (SELECT 1) SELECT oid AS observation_id, cid AS claim_id, score FROM t")
def al01_pair_scores(m: Model) -> DataFrame:
    rows = _assertions(m)
    scored = reconcile.scored_pairs(rows.where("id % 50 = 0"), rows, itself=False)
    return scored.select(F.col("o_id").alias("observation_id"), F.col("c_id").alias("claim_id"), "score")


@query(RECON + r"""r AS (SELECT *, row_number() OVER (PARTITION BY oid ORDER BY score DESC, cid) AS place, lead(score) OVER (PARTITION BY oid ORDER BY score DESC, cid) AS second FROM t),
b AS (SELECT *, CASE WHEN scoped AND op <> cp AND op <> 'conditional' AND cp <> 'conditional' THEN 'contradiction' WHEN scoped AND NOT coalesce(num, true) THEN 'contradiction'
 WHEN (op = 'conditional' OR (oh <> ch AND ch = 'certain') OR regexp_matches(ot, '(?i)\b(only|unless|when|if|provided|limited to|under)\b')) AND (scoped OR keyed) THEN 'qualification'
 WHEN head AND len(oo) > len(co) AND contains(oo, co) THEN 'elaboration'
 WHEN keyed OR (score >= 0.92 AND scoped) THEN CASE WHEN NOT keyed AND coalesce(score - second < 0.10, false) THEN 'near_duplicate' ELSE 'same_claim' END WHEN score >= 0.78 THEN 'near_duplicate' ELSE 'new_claim' END AS k FROM r WHERE place = 1)
SELECT o.p_partkey AS observation_id, coalesce(k, 'new_claim') AS classification, coalesce(score, 0.0) AS score,
 CASE WHEN keyed THEN 'canonical_key_exact' WHEN score >= 0.92 AND scoped THEN 'entity_aware_v3' ELSE 'lexical_rules_v2' END AS method,
 CASE WHEN coalesce(k, 'new_claim') <> 'new_claim' THEN cid END AS matched_claim_id, CASE WHEN k = 'same_claim' THEN CAST(cid AS STRING) ELSE 'claim_' || CAST(o.p_partkey AS STRING) END AS canonical_claim_id
FROM (SELECT p_partkey FROM part WHERE p_partkey % 50 = 0) o LEFT JOIN b ON b.oid = o.p_partkey""")
def al03_reconcile_batch(m: Model) -> DataFrame:
    rows = _assertions(m)
    return reconcile.plan_batch(rows.where("id % 50 = 0"), rows, itself=False)


@query(rf"""WITH {ASSERTIONS}, k AS (SELECT *, {UNI.format('subject')} || '|' || {UNI.format('predicate')} || '|' || {UNI.format("coalesce(object, '')")} || '|' || coalesce(CAST(value AS STRING) || '_' || unit, '') AS key FROM x)
SELECT CAST(id AS STRING) AS observation_id, 'claim_' || CAST(first_value(id) OVER (PARTITION BY family_id, key ORDER BY id) AS STRING) AS canonical_claim_id, id = first_value(id) OVER (PARTITION BY family_id, key ORDER BY id) AS created FROM k""")
def str09_reconcile_in_order(m: Model) -> DataFrame:
    return reconcile.plan_in_order(_assertions(m), "id")


@query()
def str09_ladder_in_order(m: Model) -> DataFrame:
    """Every assertion in order of its id against the claims that earlier ones made, by the whole ladder; tested by a fold."""
    return ordered.plan_ladder(_assertions(m), "id")


@query()
def ev03_scenarios(m: Model) -> DataFrame:
    """Scenarios of ten assertions each, the first of them a seed, replayed side by side; the gold cluster is the kind of part.

    Tested by a fold and B-cubed of each scenario by itself."""
    k = F.col("id")
    gold = m.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("gold"))
    rows = _assertions(m).drop("family_id").join(gold, "id").withColumns({"scenario": F.floor(k / 10).cast("long"), "seed": k % 10 == 0})
    return ordered.scenario_scores(rows.withColumn("subject", F.element_at(F.split("subject", " "), 1)), "id")


@query(f"""WITH RECURSIVE {SETS}, e AS (SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.block = b.block AND a.id % 2 = b.id % 2 AND a.id <> b.id AND len(a.t) > 0 AND len(b.t) > 0
WHERE round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE, 6) >= 0.92), r AS (SELECT id AS a, id AS b FROM s UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a AS id, min(b) AS cluster FROM r GROUP BY a)
SELECT cluster, count(*) AS members, arg_max(id, id % 7 * 1000000000 - id) AS representative, count(DISTINCT id % 5) AS n_sources FROM c GROUP BY 1""")
def ag17_cluster_summary(m: Model) -> DataFrame:
    findings = _findings(m).withColumn("positive", F.col("id") % 2 == 0)
    described = findings.select("id", (F.col("id") % 7).alias("confidence"), (F.col("id") % 5).alias("source"))
    return graph.cluster_summary(described, graph.linked_findings(findings, ["block"]))


@query("""WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT q.id AS query, e.id AS id, list_cosine_similarity(q.v, e.v) AS s FROM e q JOIN e ON q.id <> e.id WHERE q.id % 50 = 0)
SELECT query, id, place, round(s, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, id) AS place FROM p) WHERE place <= 10""")
def al04_neighbours(m: Model) -> DataFrame:
    """The ten nearest of all vectors to each whose id is divisible by 50."""
    rows = m.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    return neighbours.nearest(rows.where("id % 50 = 0"), rows, 10).select("query", "id", "place", F.round("score", 5).alias("score"))


@query()
def al04_vector_edges(m: Model) -> DataFrame:
    """Edges between all claims whose vectors are near, by the eight nearest neighbours of each; tested by brute force."""
    rows = m.embeddings.select(F.col("vec_id").alias("id"), F.concat(F.lit("subject "), F.col("vec_id").cast("string")).alias("subject"), F.lit("is").alias("predicate"), F.concat(F.lit("object "), (F.col("vec_id") * 7).cast("string")).alias("object"), F.col("embedding").cast("array<double>").alias("embedding"))
    near = neighbours.nearest(rows, rows, 8).select(F.col("query").alias("a"), F.col("id").alias("b"))
    return cluster.claim_edges(rows, near).select("a", "b", "method", "score", "relation", "strength")
