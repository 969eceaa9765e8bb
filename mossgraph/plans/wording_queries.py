"""Keys, tiers, labels, escaping and parsing, over tables with text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import addresses, text, wording
from .model import Model
from .registry import query

CONTENT = "(" + ", ".join(f"'{w}'" for w in wording.CONTENT_STOP_WORDS) + ")"


def pick(value: Column, *choices: str) -> Column:
    """One of ``choices`` by a number."""
    return F.element_at(F.array(*map(F.lit, choices)), (F.pmod(value, F.lit(len(choices))) + 1).cast("int"))


def pick_sql(value: str, *choices: str) -> str:
    return f"CASE {value} % {len(choices)} " + " ".join("WHEN {} THEN '{}'".format(k, c.replace("'", "''")) for k, c in enumerate(choices)) + " END"


@query(rf"""SELECT item_id, md5(array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex(lower(text), '[^a-z0-9@._/\-]+'), lambda t: regexp_replace(t, '^[._/\-]+|[._/\-]+$', '', 'g')), lambda t: len(t) > 2 AND t NOT IN {CONTENT}))), ',')) AS terms FROM benchmark""")
def fn04_content_terms(m: Model) -> DataFrame:
    return m.benchmark.select("item_id", F.md5(F.array_join(F.array_sort(text.anchor_terms(F.col("text"), wording.CONTENT_STOP_WORDS)), ",").cast("binary")).alias("terms"))


DISCRIMINATING = ("The Model Context Protocol v1.2", "OpenAPI uses REST and HTTP", "Red Blue Green 2024-01-02", "plain words only", "@Scope/pkg-1 in New York City")


@query(rf"""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(list_concat(list_concat(
  list_transform(list_concat(list_concat(regexp_extract_all(t, '(?i)@[a-z0-9][\w.-]*/[a-z0-9][\w.-]*'), regexp_extract_all(t, '(?i)\bv?\d+(?:\.\d+)*(?:-[\w.]+)?\b')), regexp_extract_all(t, '\b\d{{4}}-\d{{2}}-\d{{2}}\b')), lambda x: lower(x)),
  list_filter(list_transform(regexp_extract_all(t, '\b[A-Z][a-z0-9]+(?:\s+[A-Z][a-z0-9]+)+\b'), lambda x: regexp_replace(lower(x), '\s+', ' ', 'g')), lambda x: x <> 'model context protocol')),
  list_transform(regexp_extract_all(t, '\b[A-Z]{{2,}}\b'), lambda x: lower(x))), CASE WHEN regexp_matches(t, '(?i)\bmodel context protocol\b') THEN ['mcp'] ELSE [] END))), ',') AS found
FROM (SELECT p_partkey, {pick_sql('p_partkey', *DISCRIMINATING)} || ' ' || p_brand || ' ' || p_type AS t FROM part)""")
def fn13_discriminators(m: Model) -> DataFrame:
    t = F.concat_ws(" ", pick(F.col("p_partkey"), *DISCRIMINATING), F.col("p_brand"), F.col("p_type"))
    return m.part.select("p_partkey", F.array_join(F.array_sort(text.discriminators(t)), ",").alias("found"))


VERBS = ("Reduces", "was improved;", "using", "outperforming", "requires-all", "shows and employed", "is")
STEM_SQL = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9_\\s-]', ' ', 'g'), '\\s+', ' ', 'g')"
STEMMED = f"trim({STEM_SQL})"
for _base, _forms in wording.VERB_FORMS:
    STEMMED = f"regexp_replace({STEMMED}, '\\b({_forms})\\b', '{_base}', 'g')"
P17 = pick_sql("p_partkey", *VERBS) + " || ' ' || p_name"


@query(f"SELECT p_partkey, {STEMMED.format(P17)} AS stem FROM part")
def fn16_predicate_stem(m: Model) -> DataFrame:
    return m.part.select("p_partkey", wording.predicate_stem(F.concat_ws(" ", pick(F.col("p_partkey"), *VERBS), "p_name")).alias("stem"))


@query(rf"""WITH k AS (SELECT p_partkey AS id, lower(p_name) AS s, lower(p_type) AS p FROM part), j AS (SELECT a.id AS a, b.id AS b, a.s = b.s AND a.p = b.p AS same, list_distinct(string_split(a.s, ' ')) AS x, list_distinct(string_split(b.s, ' ')) AS y, string_split(a.p, ' ') AS u, string_split(b.p, ' ') AS v FROM k a JOIN k b ON b.id = a.id + 1)
SELECT a, b, same OR (len(list_intersect(x, y)) / least(len(x), len(y))::DOUBLE >= 0.6 AND (len(list_intersect(u, v)) > 0 OR len(list_intersect(x, y)) >= least(len(x), len(y)))) AS alike FROM j""")
def fn17_keys_match(m: Model) -> DataFrame:
    key = lambda c: wording.key_words(F.col(c))
    a = m.part.select(F.col("p_partkey").alias("a"), key("p_name").alias("s"), key("p_type").alias("p"))
    b = m.part.select((F.col("p_partkey") - 1).alias("a"), F.col("p_partkey").alias("b"), key("p_name").alias("t"), key("p_type").alias("q"))
    return a.join(b, "a").select("a", "b", wording.keys_match(F.col("s"), F.col("p"), F.col("t"), F.col("q")).alias("alike"))


SITES = ("https://github.com/a/b", "https://pypi.org/x", "https://wikipedia.org/", "https://math.stackexchange.com/q", "https://old.reddit.com/r", "https://news.ycombinator.com/", "https://api.semanticscholar.org/", "https://youtu.be/x", "https://my.documentation.io/", "https://other.example/")
SITE_KINDS = ("github", "package_registry", "wikipedia", "stackoverflow", "reddit", "hackernews", "academic", "youtube", "documentation", "news")


@query(f"SELECT page_id, {pick_sql('page_id', *SITE_KINDS)} AS kind FROM pages")
def fn24_source_type(m: Model) -> DataFrame:
    return m.pages.select("page_id", addresses.kind_of(pick(F.col("page_id"), *SITES), F.lit("news")).alias("kind"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN l_discount * 10 > 0.8 THEN 'certain' WHEN l_discount * 10 > 0.5 THEN 'likely' ELSE 'uncertain' END AS hedge FROM lineitem")
def fn31_hedge(m: Model) -> DataFrame:
    return m.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", wording.hedge_of(F.col("l_discount") * 10).alias("hedge"))


@query("""SELECT p_partkey, p_name || ' ' || p_type || ' ' || coalesce(o, '') AS spaced, p_name || ' ' || p_type || CASE WHEN coalesce(o, '') = '' THEN '' ELSE ' ' || o END AS joined, md5(p_name || chr(10) || p_type || CASE WHEN coalesce(o, '') = '' THEN '' ELSE chr(10) || o END) AS lines
FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_brand END AS o FROM part)""")
def fn33_rendered(m: Model) -> DataFrame:
    o = F.when(F.col("p_partkey") % 3 == 1, F.lit("")).when(F.col("p_partkey") % 3 == 2, F.col("p_brand"))
    as_text = lambda style: wording.rendered(F.col("p_name"), F.col("p_type"), o, style)
    return m.part.select("p_partkey", as_text("spaced").alias("spaced"), as_text("joined").alias("joined"), F.md5(as_text("lines").cast("binary")).alias("lines"))


GAPS = tuple(wording.GAP_PRIORITY)


@query(f"SELECT s_suppkey, {pick_sql('s_suppkey', *map(str, wording.GAP_PRIORITY.values()))}::INT AS priority, {pick_sql('s_suppkey', *GAPS)} || '::' || CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_nationkey AS STRING) ELSE '' END || '::' || CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE '' END AS key FROM supplier")
def fn36_gap_keys(m: Model) -> DataFrame:
    k = F.col("s_suppkey")
    category = pick(k, *GAPS)
    return m.supplier.select("s_suppkey", wording.gap_priority(category).alias("priority"), wording.gap_key(category, F.when(k % 2 == 0, F.col("s_nationkey")), F.when(k % 3 == 0, F.col("s_name"))).alias("key"))


SCOPE = "(" + ", ".join(f"'{w}'" for w in text.SCOPE_STOP_WORDS) + ")"
LABEL = r"list_filter(string_split_regex(regexp_replace(lower({0}), '[^a-z0-9\s\-]', ' ', 'g'), '\s+'), lambda t: len(t) > 1 AND t NOT IN {1})"


@query(rf"""SELECT item_id, CASE WHEN len(t) = 0 THEN 'Research Family' ELSE array_to_string(list_transform(t[1:8], lambda w: upper(w[1]) || w[2:]), ' ') END AS family, CASE WHEN len(t) = 0 THEN 'Research Thread' ELSE array_to_string(list_transform(t[1:6], lambda w: upper(w[1]) || w[2:]), ' ') END AS thread
FROM (SELECT item_id, {LABEL.format('text', SCOPE)} AS t FROM benchmark)""")
def fn37_labels(m: Model) -> DataFrame:
    t = text.scope_tokens(F.col("text"))
    return m.benchmark.select("item_id", text.title_label(t, 8, "Research Family").alias("family"), text.title_label(t, 6, "Research Thread").alias("thread"))


RAW = ("- *bold* and _it_ \\ [x](y)\n> q", "  - item + `code` #1", "plain (a) text")
RAW_SQL = "CASE p_partkey % 3 WHEN 0 THEN '- *bold* and _it_ \\ [x](y)' || chr(10) || '> q' WHEN 1 THEN '  - item + `code` #1' ELSE 'plain (a) text' END"


@query(rf"""SELECT p_partkey, regexp_replace(regexp_replace(replace(regexp_replace(t, '[\r\n]+', ' ', 'g'), '\', '\\'), '([>`#*+_\]])', '\\\1', 'g'), '^([ \t]*)- ', '\1\\- ') AS escaped, replace(replace(t, '(', '%28'), ')', '%29') AS link,
upper(t[1]) || t[2:] AS up, lower(p_name[1]) || p_name[2:] AS down FROM (SELECT p_partkey, p_name, {RAW_SQL} || p_brand AS t FROM part)""")
def fn38_markdown(m: Model) -> DataFrame:
    t = F.concat(pick(F.col("p_partkey"), *RAW), F.col("p_brand"))
    return m.part.select("p_partkey", wording.markdown_text(t).alias("escaped"), wording.link_target(t).alias("link"), wording.first_upper(t).alias("up"), wording.first_upper(F.col("p_name"), False).alias("down"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE sha256(props) END AS found FROM events")
def fn40_json_in_text(m: Model) -> DataFrame:
    k = F.col("event_id") % 4
    said = F.when(k == 0, F.concat(F.lit("  "), "props", F.lit("\n"))).when(k == 1, F.concat(F.lit("Here:\n```\nnot json\n```\n```json\n"), "props", F.lit("\n```\nand so on"))).when(k == 2, F.concat(F.lit("```JSON "), "props", F.lit(" ```"))).otherwise(F.lit("none {x"))
    return m.events.select("event_id", F.sha2(wording.json_in(said).cast("binary"), 256).alias("found"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'answer' WHEN 1 THEN 'action' ELSE 'error' END AS kind, CASE WHEN p_partkey % 3 < 2 THEN p_name ELSE '' END AS thought, CASE WHEN p_partkey % 3 = 1 THEN 'search' END AS tool,
CASE WHEN p_partkey % 3 = 1 THEN '{"q":"' || p_type || '"}' END AS arguments, CASE WHEN p_partkey % 3 = 0 THEN p_type || chr(10) || 'ACTION: none' END AS answer FROM part""")
def fn41_agent_response(m: Model) -> DataFrame:
    k = F.col("p_partkey") % 3
    said = F.when(k == 0, F.concat(F.lit("Thought: "), "p_name", F.lit("\nANSWER: "), "p_type", F.lit("\nACTION: none"))).when(k == 1, F.concat(F.lit("THOUGHT: "), "p_name", F.lit('\nACTION: search\nARGUMENTS: {"q":"'), "p_type", F.lit('"}\nTHOUGHT: x'))).otherwise(F.col("p_name"))
    return m.part.select("p_partkey", wording.agent_response(said).alias("r")).select("p_partkey", "r.*")


@query("""SELECT event_id, CASE WHEN event_id % 10 IN (1, 2, 4, 6, 8) THEN 'PERMANENT' ELSE 'TRANSIENT' END AS class FROM events""")
def fn43_error_class(m: Model) -> DataFrame:
    k = F.col("event_id") % 10
    none = F.lit(None).cast("string")
    return m.events.select("event_id", wording.error_class(
        F.when(k == 1, F.lit("AbortError")).otherwise(F.lit("Error")), F.when(k == 2, F.lit("PERMANENT")), F.when(k == 4, F.lit(-32602)), F.when(k == 5, F.lit(503)).when(k == 6, F.lit(404)),
        F.when(k == 7, F.lit("ETIMEDOUT")).when(k == 8, F.lit("ENOTFOUND")).otherwise(none), F.when(k == 9, F.lit("Socket hang up")).otherwise(F.lit("other")),
    ).alias("class"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END + least(o_custkey % 9, 5) - CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS score,
round(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE 0 END + o_custkey, 2) AS rank FROM orders""")
def fn44_finding_scores(m: Model) -> DataFrame:
    k = F.col("o_orderkey")
    directness = pick(k, "direct", "near-direct", "indirect")
    return m.orders.select(
        "o_orderkey", wording.finding_confidence(directness, F.col("o_custkey") % 9, F.when(k % 2 == 0, 2).otherwise(0)).alias("score"),
        F.round(wording.source_rank(F.when(k % 2 == 0, F.col("o_totalprice").cast("double")), F.col("o_custkey").cast("double"), F.lit(None).cast("double")), 2).alias("rank"),
    )


@query("""SELECT id, CASE WHEN authority_class IN ('official_spec', 'official_changelog') THEN 'primary' WHEN authority_class IN ('official_repo', 'package_registry') THEN 'secondary' ELSE 'tertiary' END AS tier,
CASE WHEN id % 80 <= 10 THEN 'quick' WHEN id % 80 <= 25 THEN 'standard' WHEN id % 80 <= 60 THEN 'deep' ELSE 'exhaustive' END AS depth FROM sources""")
def fn45_tiers_depth(m: Model) -> DataFrame:
    return m.sources.select("id", wording.source_tier(F.col("authority_class")).alias("tier"), wording.depth_of(F.col("id") % 80).alias("depth"))


@query("SELECT item_id, md5(array_to_string(list_transform(string_split(text, ' ')[1:10], lambda w: w[1:5]), '|')) AS items FROM benchmark")
def fn46_sanitised_plan(m: Model) -> DataFrame:
    items = F.flatten(F.transform(F.split("text", " "), lambda w: F.array(w, F.lit(None).cast("string"))))
    return m.benchmark.select("item_id", F.md5(F.array_join(wording.sanitised(items, 5, 10), "|").cast("binary")).alias("items"))


@query("SELECT event_id, 'evt_' || substr(sha256(CAST(user_id AS STRING) || '|' || CAST(event_id AS STRING)), 1, 26) AS id FROM events")
def fn47_opaque_ids(m: Model) -> DataFrame:
    return m.events.select("event_id", wording.opaque_id(F.col("user_id"), F.col("event_id"), prefix="evt_").alias("id"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0 OR (o_custkey % 100) / 100.0 >= 0.72")
def flt10_admissible(m: Model) -> DataFrame:
    scored = m.orders.withColumn("relevance", F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_custkey") % 100) / 100.0))
    return scored.where("relevance is null or relevance >= 0.72").select("o_orderkey")


@query(r"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'LIKELY_HALLUCINATED' ELSE 'OK' END AS verdict FROM pages")
def flt12_url_check(m: Model) -> DataFrame:
    given = F.when(F.col("page_id") % 3 == 0, pick(F.col("page_id"), "not a url", "http://", "//x", "")).otherwise(F.col("url"))
    return m.pages.select("page_id", wording.url_check(given).alias("verdict"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN '{"runId":"r' || CAST(user_id AS STRING) || '"' || CASE WHEN event_id % 2 = 0 THEN ',"phase":"p"' ELSE '' END || ',"percent":' || CAST(event_id % 100 AS STRING) || '}' WHEN 'error' THEN '{"runId":"r' || CAST(user_id AS STRING) || '","error":{"code":7}}' ELSE '{}' END AS shown FROM events""")
def flt13_shown_payload(m: Model) -> DataFrame:
    n = F.col("event_id")
    kind = F.when(F.col("event_type") == "view", F.lit("RUN_PROGRESS")).when(F.col("event_type") == "error", F.lit("RUN_FAILED")).otherwise(F.lit("CLAIM_OBSERVED"))
    body = F.to_json(F.struct(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("runId"), F.lit("s3cret").alias("lease"), F.when(n % 2 == 0, F.lit("p")).alias("phase"), (n % 100).alias("percent"), F.struct(F.lit(7).alias("code")).alias("error")))
    return m.events.select("event_id", wording.shown_payload(kind, body).alias("shown"))


@query("SELECT seq, event_type FROM log WHERE event_type IN ('RUN_QUEUED', 'RUN_RUNNING', 'RUN_COMPLETED', 'RUN_FAILED')")
def flt14_lifecycle(m: Model) -> DataFrame:
    from ..operators import ledger

    return ledger.lifecycle(m.log, heartbeats=False).where("event_type <> 'RUN_PROGRESS'").select("seq", "event_type")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN repeat('x', 40) || '…' ELSE p_brand || chr(9) END AS bounded, CASE WHEN p_partkey % 2 = 0 THEN repeat('é', 20) || '…' ELSE repeat('é', 3) END AS accents FROM part""")
def flt15_bounded_fields(m: Model) -> DataFrame:
    even = F.col("p_partkey") % 2 == 0
    long = F.when(even, F.concat(F.lit("\x07"), F.repeat(F.lit("x"), F.lit(90)))).otherwise(F.concat("p_brand", F.lit("\x00\t\x9f")))
    accents = F.when(even, F.repeat(F.lit("é"), F.lit(30))).otherwise(F.repeat(F.lit("é"), F.lit(3)))
    return m.part.select("p_partkey", wording.bytes_capped(wording.without_controls(long), 43).alias("bounded"), wording.bytes_capped(accents, 44).alias("accents"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 50 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 100 ELSE 7 END AS page FROM orders")
def flt16_page_limits(m: Model) -> DataFrame:
    k = F.col("o_orderkey") % 5
    given = F.when(k == 1, 0.0).when(k == 2, 2.5).when(k == 3, 5000.0).when(k == 4, 7.0)
    return m.orders.select("o_orderkey", wording.page_limit_column(given).alias("page"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'some words' ELSE NULL END AS words, page_id % 3 = 2 AS error FROM pages")
def flt17_search_text(m: Model) -> DataFrame:
    k = F.col("page_id") % 3
    given = F.when(k == 0, F.lit("  some words ")).when(k == 1, F.lit("   ")).otherwise(F.repeat(F.lit("w"), F.lit(201)))
    return m.pages.select("page_id", wording.search_text(given).alias("t")).select("page_id", F.col("t.text").alias("words"), F.col("t.error").alias("error"))


@query("SELECT p_partkey, array_to_string(list_sort(list_concat(list_filter(x, lambda t: NOT list_contains(y, t)), list_filter(y, lambda t: NOT list_contains(x, t)))), ',') AS gap FROM (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS x, [split_part(p_name, ' ', 1), lower(p_brand)] AS y FROM part)")
def se04_symmetric_difference(m: Model) -> DataFrame:
    y = F.array(F.split("p_name", " ")[0], F.lower("p_brand"))
    return m.part.select("p_partkey", F.array_join(text.discriminator_gap(F.array_distinct(F.split("p_name", " ")), y), ",").alias("gap"))


SPECIAL = (
    "https://doi.org/10.1000/ABC.Def", "https://dx.doi.org/10.1000/ABC?x=1#f", "https://pub.example/doi/10.5555/Q-1", "https://GitHub.com/Org/Repo.git", "https://github.com/Org/Repo/", "HTTP://Example.COM/?utm_source=a", "https://e.example/p?b=2&a=1&fbclid=z#frag", "  not a url ",
)
CANONICAL = (
    "https://doi.org/10.1000/abc.def", "https://doi.org/10.1000/abc", "https://doi.org/10.5555/q-1", "https://github.com/Org/Repo", "https://github.com/Org/Repo", "http://example.com", "https://e.example/p?a=1&b=2", "not a url",
)


@query(f"SELECT page_id, {pick_sql('page_id', *CANONICAL)} AS canonical FROM pages")
def fn21_special_addresses(m: Model) -> DataFrame:
    """DOIs by resolver and inside other addresses, repositories, tracking and order of parameters, what is no address."""
    return m.pages.select("page_id", addresses.canonical_url(pick(F.col("page_id"), *SPECIAL)).alias("canonical"))


OWNERS = ("https://github.com/nodejs/node", "https://www.github.com/microsoft/x/y", "https://github.com/someone/z", "https://github.com/onlyowner", "https://rubygems.org/g", "https://de.wikipedia.org/wiki/X", "https://e.example/")
OWNER_CLASSES = ("official_repo", "official_repo", "third_party_analysis", "news", "package_registry", "encyclopedia", "news")


@query(f"SELECT page_id, {pick_sql('page_id', *OWNER_CLASSES)} AS authority_class FROM pages")
def fn23_owners(m: Model) -> DataFrame:
    return m.pages.select("page_id", addresses.authority_of(pick(F.col("page_id"), *OWNERS), F.lit("news")).alias("authority_class"))
