"""Requests to providers and the shapes of their responses, as column expressions over VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.addresses import fetchable
from ..functions.text import djb2
from ..functions.wording import ARRAY_MOST, BODY_FIELD, MEDIUM_FIELD, SHORT_FIELD
from .providers import bounded, results

# The tool that gives each capability, and the back ends of the one for papers.
CAPABILITIES = {
    "search": "web_search", "read": "web_crawl", "academic": "research", "code": "github", "reddit": "reddit", "hackernews": "research", "stackoverflow": "research", "media": "youtube", "reference": "research", "browser": "browser",
}
BACKENDS = ("arxiv", "semantic_scholar", "openalex", "crossref", "pubmed", "wikipedia", "hackernews", "stackoverflow", "datacite", "ror", "gdelt", "wikidata")
# The tool of each request, its constant arguments, and the names that its arguments have there.
REQUESTS = {
    "search": ("web_search", {}, {"query": "query", "limit": "limit", "freshness": "freshness"}), "read": ("web_crawl", {"maxDepth": "1", "maxPages": "1"}, {"url": "url"}), "crawl": ("web_crawl", {}, {"url": "url", "maxPages": "maxPages"}),
    "academic": ("research", {"action": "academic"}, {"query": "query", "source": "source", "limit": "limit", "yearFrom": "yearFrom"}), "github": ("github", {"action": "search"}, {"query": "query", "limit": "limit"}),
    "reddit": ("reddit", {"action": "search", "subreddit": "all"}, {"query": "query", "subreddit": "subreddit", "limit": "limit"}), "reddit_thread": ("reddit", {"action": "comments"}, {"url": "url"}),
    "hackernews": ("research", {"action": "hackernews"}, {"query": "query", "limit": "limit"}), "stackoverflow": ("research", {"action": "stackoverflow"}, {"query": "query", "limit": "limit"}),
    "youtube": ("youtube", {"action": "search"}, {"query": "query", "limit": "maxResults"}), "transcript": ("youtube", {"action": "transcript"}, {"videoId": "videoId", "language": "language"}),
    "wikipedia": ("research", {"action": "wikipedia"}, {"query": "query", "language": "language"}),
}
NEED_ADDRESS = ("read", "crawl", "reddit_thread")


def text_of(name: str, value: str = "item") -> Column:
    """A field that is a string; null for anything else."""
    return F.expr(f"CASE WHEN schema_of_variant(try_variant_get({value}, '$.{name}', 'variant')) = 'STRING' THEN try_variant_get({value}, '$.{name}', 'string') END")


def number_of(name: str, value: str = "item", kind: str = "double") -> Column:
    """A field that is a number; null for anything else."""
    return F.expr(f"CASE WHEN schema_of_variant(try_variant_get({value}, '$.{name}', 'variant')) RLIKE '^(BIGINT|DOUBLE|DECIMAL|FLOAT)' THEN try_variant_get({value}, '$.{name}', '{kind}') END")


def filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def capabilities(tools: Column) -> Column:
    """What a provider can do, by the names of its tools; required are search and read."""
    flags = [F.array_contains(tools, tool).alias(name) for name, tool in CAPABILITIES.items()]
    ready = F.array_contains(tools, CAPABILITIES["search"]) & F.array_contains(tools, CAPABILITIES["read"])
    backends = F.when(F.array_contains(tools, "research"), F.array(*map(F.lit, BACKENDS)))
    return F.struct(*flags, ready.alias("ready"), backends.alias("backends"))


def request(method: str, **given: Column) -> Column:
    """``(tool, arguments)`` of a call; arguments that are null are left out; null where an address may not be fetched."""
    tool, constant, names = REQUESTS[method]
    pairs = {k: F.lit(v) for k, v in constant.items()} | {}
    for name, column in given.items():
        target = names[name]
        pairs[target] = F.coalesce(column.cast("string"), pairs[target]) if target in pairs else column.cast("string")
    made = F.struct(F.lit(tool).alias("tool"), F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull()).alias("arguments"))
    return F.when(fetchable(given["url"]), made) if method in NEED_ADDRESS else made


def unwrapped(body: Column) -> Column:
    """The part of an envelope that holds the data: ``data.details``, else ``data.content``, else ``data``, else all of it."""
    value = F.try_parse_json(body)
    inside = lambda path: F.try_variant_get(value, path, "variant")
    return F.coalesce(inside("$.data.details"), inside("$.data.content"), inside("$.data"), value)


def read_results(responses: DataFrame, body: str = "body", key: str = "id") -> DataFrame:
    """``(id, url, content, title, published, content_hash)``: the first page, or the body's own fields."""
    rows = responses.select(key, "url", F.try_parse_json(body).alias("item"))
    content = bounded(F.coalesce(filled(text_of("pages[0].content"), text_of("content")), F.lit("")), BODY_FIELD)
    return rows.select(key, "url", content.alias("content"), bounded(filled(text_of("pages[0].title"), text_of("title")), SHORT_FIELD).alias("title"), bounded(text_of("pages[0].published"), SHORT_FIELD).alias("published"), djb2(content).alias("content_hash"))


def crawl_results(responses: DataFrame, body: str = "body", key: str = "id") -> DataFrame:
    """``(id, ord, url, content, depth, title)`` of pages with an address that may be fetched and content."""
    rows = results(responses, body, key).where(F.col("ord") < ARRAY_MOST)
    out = rows.select(key, "ord", text_of("url").alias("url"), bounded(text_of("content"), BODY_FIELD).alias("content"), F.coalesce(number_of("depth", kind="int"), F.lit(0)).alias("depth"), bounded(text_of("title"), SHORT_FIELD).alias("title"))
    return out.where((F.col("content") != "") & fetchable(F.col("url")))


def forum_hits(responses: DataFrame, body: str = "body", key: str = "id") -> DataFrame:
    """``(id, ord, title, url, subreddit, score, n_comments, created)``; the time is null where the response has none."""
    rows = results(responses, body, key).where(F.col("ord") < ARRAY_MOST)
    out = rows.select(
        key, "ord", bounded(text_of("title"), SHORT_FIELD).alias("title"), text_of("url").alias("url"), bounded(text_of("subreddit"), SHORT_FIELD).alias("subreddit"), F.coalesce(number_of("score"), F.lit(0.0)).alias("score"),
        F.coalesce(number_of("numComments", kind="int"), number_of("num_comments", kind="int"), F.lit(0)).alias("n_comments"), bounded(F.coalesce(text_of("createdAt"), text_of("created")), SHORT_FIELD).alias("created"),
    )
    return out.where((F.col("title") != "") & (F.col("subreddit") != "") & fetchable(F.col("url")))


def forum_threads(responses: DataFrame, body: str = "body", key: str = "id") -> DataFrame:
    """``(id, title, url, body, comments)``; an address that may not be fetched becomes empty."""
    rows = responses.select(key, F.try_parse_json(body).alias("item"))
    url = filled(text_of("post.url"), text_of("url"))
    empty = lambda c: F.coalesce(c, F.lit(""))
    comments = F.transform(
        F.slice(F.expr("coalesce(try_variant_get(item, '$.comments', 'array<struct<author string, body string, score double>>'), array())"), 1, ARRAY_MOST),
        lambda c: F.struct(bounded(F.coalesce(c["author"], F.lit("[unknown]")), SHORT_FIELD).alias("author"), bounded(empty(c["body"]), MEDIUM_FIELD).alias("body"), F.coalesce(c["score"], F.lit(0.0)).alias("score")),
    )
    return rows.select(key, bounded(empty(filled(text_of("post.title"), text_of("title"))), SHORT_FIELD).alias("title"), F.when(fetchable(url), url).otherwise(F.lit("")).alias("url"), bounded(empty(filled(text_of("post.selftext"), text_of("body"))), BODY_FIELD).alias("body"), comments.alias("comments"))


def video_hits(responses: DataFrame, body: str = "body", key: str = "id") -> DataFrame:
    """``(id, ord, video_id, title, channel, published, url)``; an id may stand inside another object."""
    rows = results(responses, body, key).where(F.col("ord") < ARRAY_MOST)
    video = F.coalesce(text_of("videoId"), text_of("id.videoId"))
    url = F.coalesce(text_of("url"), F.concat(F.lit("https://www.youtube.com/watch?v="), video))
    out = rows.select(key, "ord", bounded(video, SHORT_FIELD).alias("video_id"), bounded(text_of("title"), SHORT_FIELD).alias("title"), bounded(F.coalesce(text_of("channelTitle"), text_of("channel"), F.lit("")), SHORT_FIELD).alias("channel"), bounded(F.coalesce(text_of("publishedAt"), text_of("published")), SHORT_FIELD).alias("published"), url.alias("url"))
    return out.where((F.col("video_id") != "") & (F.col("title") != "") & fetchable(F.col("url")))


def transcript_segments(responses: DataFrame, body: str = "body", key: str = "id") -> DataFrame:
    """``(id, ord, text, start, duration)`` of segments with text."""
    rows = results(responses, body, key).where(F.col("ord") < ARRAY_MOST)
    return rows.select(key, "ord", bounded(text_of("text"), MEDIUM_FIELD).alias("text"), F.coalesce(number_of("start"), F.lit(0.0)).alias("start"), F.coalesce(number_of("duration"), F.lit(0.0)).alias("duration")).where("text <> ''")


class FixtureProvider(DataSource):
    """``spark.read.format("fixture_provider").option("path", folder)``: recorded responses, ``<method>/<id>.json``, no network."""

    @classmethod
    def name(cls) -> str:
        return "fixture_provider"

    def schema(self) -> str:
        return "method string, id string, body string"

    def reader(self, schema) -> FixtureReader:
        return FixtureReader(self.options["path"])


class FixtureReader(DataSourceReader):
    """One partition a method, so that methods are read in parallel."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        import os

        return [InputPartition(name) for name in sorted(os.listdir(self.path))]

    def read(self, partition):
        import pathlib

        for file in sorted((pathlib.Path(self.path) / partition.value).glob("*.json")):
            yield partition.value, file.stem, file.read_text(encoding="utf-8")
