"""Provider responses as VARIANT: finding the array of results and mapping hits of any of their shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import fetchable, host_of
from ..functions.wording import MEDIUM_FIELD, SHORT_FIELD, bytes_capped, without_controls

# Where responses keep their results.
ARRAYS = ("results", "items", "papers", "pages", "videos", "repositories", "posts", "comments")
HITS = 100


def bounded(text: Column, most: int) -> Column:
    """Without control characters but white space, at most ``most`` bytes of UTF-8 with an ellipsis."""
    return bytes_capped(without_controls(text), most)


def results(responses: DataFrame, body: str = "body", key: str = "id") -> DataFrame:
    """``(id, ord, item)``: the first array found under a known name, else the body itself if it is one."""
    v = f"try_parse_json(`{body}`)"
    found = F.expr("coalesce(" + ", ".join([*[f"try_variant_get({v}, '$.{a}', 'array<variant>')" for a in ARRAYS], f"try_cast({v} as array<variant>)"]) + ")")
    return responses.select(key, F.posexplode(found).alias("ord", "item"))


def first_of(*paths: str) -> Column:
    return F.expr("coalesce(" + ", ".join(f"try_variant_get(item, '$.{p}', 'string')" for p in paths) + ")")


def hits(responses: DataFrame, body: str = "body", key: str = "id") -> DataFrame:
    """``(id, ord, url, title, snippet, published, domain)``: titled hits with an address that may be fetched, 100 a response."""
    rows = results(responses, body, key).where(F.col("ord") < HITS).select(
        key, "ord", first_of("url", "link").alias("url"), bounded(first_of("title"), SHORT_FIELD).alias("title"), bounded(first_of("snippet", "abstract", "description"), MEDIUM_FIELD).alias("snippet"),
        first_of("publishedAt", "published", "date").alias("published"), first_of("domain", "source", "hostname").alias("given"),
    )
    return rows.where(F.col("title").isNotNull() & fetchable(F.col("url"))).select(key, "ord", "url", "title", "snippet", "published", F.coalesce("given", host_of(F.col("url"))).alias("domain"))


def repositories(responses: DataFrame, body: str = "body", key: str = "id") -> DataFrame:
    stars = F.expr("coalesce(try_variant_get(item, '$.stargazers_count', 'long'), try_variant_get(item, '$.stars', 'long'))")
    url = first_of("html_url", "url")
    name = F.coalesce(first_of("full_name", "repo"), F.nullif(F.regexp_extract(url, r"github\.com/([^/]+/[^/?#]+)", 1), F.lit("")))
    return results(responses, body, key).select(key, "ord", name.alias("repo"), url.alias("url"), stars.alias("stars"))
