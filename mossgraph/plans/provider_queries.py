"""Requests and responses of providers, made from pages and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import mappers
from .model import Model
from .registry import query
from .wording_queries import pick


def _json(**fields) -> F.Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


@query("""SELECT p_partkey AS id, p_partkey % 2 = 0 AS search, p_partkey % 3 = 0 AS academic, p_partkey % 2 = 0 AND p_partkey % 5 > 0 AS ready, CASE WHEN p_partkey % 3 = 0 THEN 12 END AS backends FROM part""")
def src08_capabilities(m: Model) -> DataFrame:
    k = F.col("p_partkey")
    tools = F.filter(F.array(F.when(k % 2 == 0, F.lit("web_search")), F.when(k % 5 > 0, F.lit("web_crawl")), F.when(k % 3 == 0, F.lit("research"))), lambda t: t.isNotNull())
    c = m.part.select(k.alias("id"), mappers.capabilities(tools).alias("c"))
    return c.select("id", "c.search", "c.academic", "c.ready", F.when(F.col("c.backends").isNotNull(), F.size("c.backends")).alias("backends"))


@query("""SELECT page_id AS id, 'https://e.example/' || CAST(page_id AS STRING) AS url, CASE page_id % 3 WHEN 0 THEN 'c' || CAST(page_id AS STRING) WHEN 1 THEN 'own' ELSE '' END AS content, CASE page_id % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'O' END AS title, CASE WHEN page_id % 3 = 0 THEN '2024' END AS published FROM pages""")
def src11_read_results(m: Model) -> DataFrame:
    k = F.col("page_id")
    page = F.array(F.struct(F.concat(F.lit("c"), k.cast("string"), F.lit("\x00")).alias("content"), F.lit("T").alias("title"), F.lit("2024").alias("published")))
    body = F.when(k % 3 == 0, _json(pages=page, content=F.lit("x"))).when(k % 3 == 1, _json(content=F.lit("own"), title=F.lit("O"))).otherwise(F.lit("[]"))
    rows = m.pages.select(k.alias("id"), F.concat(F.lit("https://e.example/"), k.cast("string")).alias("url"), body.alias("body"))
    return mappers.read_results(rows).drop("content_hash")


@query("""SELECT page_id AS id, n AS ord, 'https://e.example/' || CAST(n AS STRING) AS url, 'c' || CAST(n AS STRING) AS content, CASE WHEN n = 1 THEN 3 ELSE 0 END AS depth, CASE WHEN page_id % 2 = 0 THEN 't' END AS title FROM pages, (SELECT unnest([0, 1]) AS n)""")
def src12_crawl_results(m: Model) -> DataFrame:
    title = F.when(F.col("page_id") % 2 == 0, F.lit("t"))
    none = F.lit(None).cast("int")
    item = lambda url, content, depth: F.struct(F.lit(url).alias("url"), F.lit(content).alias("content"), depth.alias("depth"), title.alias("title"))
    items = F.array(item("https://e.example/0", "c0", none), item("https://e.example/1", "c1", F.lit(3)), item("http://127.0.0.1/", "c2", none), item("https://e.example/3", "", none))
    return mappers.crawl_results(m.pages.select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 3 == 0, _json(pages=items)).otherwise(_json(results=items)).alias("body")))


@query("""SELECT page_id AS id, 0 AS ord, 'T' || CAST(page_id AS STRING) AS title, 'https://www.reddit.com/r/x' AS url, 'x' AS subreddit, CASE WHEN page_id % 2 = 0 THEN 7.0 ELSE 0.0 END AS score, 5 AS n_comments, CASE WHEN page_id % 2 = 0 THEN 'now' END AS created FROM pages""")
def src14_forum_hits(m: Model) -> DataFrame:
    k = F.col("page_id")
    even = k % 2 == 0
    item = F.struct(F.concat(F.lit("T"), k.cast("string")).alias("title"), F.lit("https://www.reddit.com/r/x").alias("url"), F.lit("x").alias("subreddit"), F.when(even, F.lit(7)).alias("score"), F.when(even, F.lit(5)).alias("numComments"), F.when(~even, F.lit(5)).alias("num_comments"), F.when(even, F.lit("now")).alias("created"))
    bad = item.withField("url", F.lit("ftp://x"))
    return mappers.forum_hits(m.pages.select(k.alias("id"), _json(posts=F.array(item, bad)).alias("body")))


@query("""SELECT page_id AS id, CASE WHEN page_id % 2 = 0 THEN 'P' ELSE 'own' END AS title, CASE WHEN page_id % 2 = 0 THEN '' ELSE 'https://e.example/t' END AS url, CASE WHEN page_id % 2 = 0 THEN 'text' ELSE 'b' END AS body, CASE WHEN page_id % 2 = 0 THEN 2 ELSE 0 END AS comments, CASE WHEN page_id % 2 = 0 THEN '[unknown]' END AS author FROM pages""")
def src14_forum_threads(m: Model) -> DataFrame:
    none = F.lit(None).cast("string")
    post = F.struct(F.lit("P").alias("title"), F.lit("http://localhost/").alias("url"), F.lit("text").alias("selftext"))
    comments = F.array(F.struct(none.alias("author"), F.lit("c").alias("body"), F.lit(1.5).alias("score")), F.struct(F.lit("a").alias("author"), none.alias("body"), F.lit(None).cast("double").alias("score")))
    body = F.when(F.col("page_id") % 2 == 0, _json(post=post, comments=comments)).otherwise(_json(title=F.lit("own"), url=F.lit("https://e.example/t"), body=F.lit("b")))
    out = mappers.forum_threads(m.pages.select(F.col("page_id").alias("id"), body.alias("body")))
    return out.select("id", "title", "url", "body", F.size("comments").alias("comments"), F.try_element_at("comments", F.lit(1))["author"].alias("author"))


@query("""SELECT page_id AS id, 0 AS ord, 'v' || CAST(page_id AS STRING) AS video_id, 'T' AS title, CASE WHEN page_id % 2 = 0 THEN 'ch' ELSE '' END AS channel, 'https://www.youtube.com/watch?v=v' || CAST(page_id AS STRING) AS url FROM pages""")
def src15_video_hits(m: Model) -> DataFrame:
    k = F.col("page_id")
    video = F.concat(F.lit("v"), k.cast("string"))
    flat = F.concat(F.lit('{"videos":[{"videoId":"'), video, F.lit('","title":"T","channel":"ch"},{"title":"no id"}]}'))
    nested = F.concat(F.lit('{"items":[{"id":{"videoId":"'), video, F.lit('"},"title":"T"}]}'))
    return mappers.video_hits(m.pages.select(k.alias("id"), F.when(k % 2 == 0, flat).otherwise(nested).alias("body"))).drop("published")


@query("""SELECT page_id AS id, n AS ord, 's' || CAST(n AS STRING) AS text, n * 1.5 AS start, 0.0 AS duration FROM pages, (SELECT unnest([0, 1]) AS n)""")
def src15_transcript_segments(m: Model) -> DataFrame:
    return mappers.transcript_segments(m.pages.select(F.col("page_id").alias("id"), F.lit('[{"text":"s0","start":0},{"text":"s1","start":1.5,"duration":"no"},{"text":""},{"start":3}]').alias("body")))


@query("""SELECT page_id AS id, CASE page_id % 4 WHEN 0 THEN 'd' WHEN 1 THEN 'c' WHEN 2 THEN 'x' ELSE 'own' END AS value FROM pages""")
def src16_unwrapped(m: Model) -> DataFrame:
    body = pick(F.col("page_id"), '{"data":{"details":{"v":"d"},"content":{"v":"c"}}}', '{"data":{"content":{"v":"c"}}}', '{"data":{"v":"x"}}', '{"v":"own"}')
    return m.pages.select(F.col("page_id").alias("id"), F.try_variant_get(mappers.unwrapped(body), "$.v", "string").alias("value"))


@query("""SELECT p_partkey AS id, 'web_search' AS tool, 2 + CAST(p_partkey % 2 = 0 AS INT) AS n, CASE WHEN p_partkey % 3 > 0 THEN 'web_crawl' END AS reading, CASE WHEN p_partkey % 5 = 0 THEN 'spark' ELSE 'all' END AS subreddit FROM part""")
def src17_requests(m: Model) -> DataFrame:
    k = F.col("p_partkey")
    search = mappers.request("search", query=F.col("p_name"), limit=F.lit(5), freshness=F.when(k % 2 == 0, F.lit("year")))
    read = mappers.request("read", url=F.when(k % 3 > 0, F.lit("https://e.example/x")).otherwise(F.lit("http://10.0.0.1/")))
    forum = mappers.request("reddit", query=F.col("p_name"), subreddit=F.when(k % 5 == 0, F.lit("spark")))
    rows = m.part.select(k.alias("id"), search.alias("s"), read.alias("r"), forum.alias("f"))
    return rows.select("id", "s.tool", F.size("s.arguments").alias("n"), F.col("r.tool").alias("reading"), F.col("f.arguments")["subreddit"].alias("subreddit"))
