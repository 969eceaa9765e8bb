"""Web addresses as column expressions: canonical form, identifiers, hosts, what may be fetched, and authority."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING = (
    "utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_cid utm_reader utm_name utm_social utm_social-type gclid dclid gbraid wbraid "
    "fbclid msclkid mc_cid mc_eid ref ref_src referring_source igshid _ga _gl yclid ttclid li_fat_id mkt_tok"
).split()
DOI = r"(10\.\d{4,9}/[\w.\-;()/:\[\]\\]+)"
PARTS = r"^(?i)(https?)://([^/?#]+)([^?#]*)(?:\?([^#]*))?"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(F.trim(url), PARTS, k)


def host_of(url: Column) -> Column:
    """Lower-case host without ``www.``, user and port; '' where the address is not http(s)."""
    host = F.regexp_replace(F.regexp_replace(F.lower(_part(url, 2)), "^[^@]*@", ""), r":[0-9]+$", "")
    return F.regexp_replace(host, r"^www\.", "")


def canonical_url(url: Column) -> Column:
    """One spelling per resource; what cannot be parsed stays as it is, trimmed."""
    host = F.lower(_part(url, 2))
    path = _part(url, 3)
    resolver = host.isin("doi.org", "dx.doi.org") & path.rlike(DOI)
    doi = F.when(resolver, F.regexp_replace(path, "^/", "")).otherwise(F.regexp_extract(F.concat(host, path), DOI, 1))
    github = host.isin("github.com", "www.github.com")
    bare = F.regexp_replace(path, r"\.git(/?)$", "$1")
    path = F.when(github & (bare != "/"), F.regexp_replace(bare, r"/+$", "")).otherwise(path)
    pairs = F.filter(F.split(_part(url, 4), "&"), lambda p: (p != "") & ~F.regexp_replace(p, "=.*$", "").isin(*TRACKING))
    query = F.array_join(F.array_sort(pairs), "&")
    tail = F.when(query == "", F.when(path == "/", F.lit("")).otherwise(path)).otherwise(F.concat(F.when(path == "", F.lit("/")).otherwise(path), F.lit("?"), query))
    rebuilt = F.concat(F.lower(_part(url, 1)), F.lit("://"), host, tail)
    return F.when(host == "", F.trim(url)).when(doi != "", F.concat(F.lit("https://doi.org/"), F.lower(doi))).otherwise(rebuilt)


def fetchable(url: Column) -> Column:
    """http(s), at most 8 KiB, a host that is neither local nor a literal address, and no credentials."""
    raw = F.lower(_part(url, 2))
    host = F.regexp_replace(F.regexp_replace(raw, r":[0-9]+$", ""), r"\.$", "")
    local = (host == "localhost") | host.endswith(".localhost") | host.rlike(r"^[0-9.]+$") | host.startswith("[")
    return F.coalesce((F.octet_length(url) <= 8192) & (raw != "") & ~raw.contains("@") & (host != "") & ~local, F.lit(False))


# Classes of sources from best to worst, their weights, and those of kinds of evidence.
AUTHORITY = ("official_spec", "official_changelog", "official_repo", "vendor_docs", "package_registry", "vendor_sdk_docs", "third_party_analysis", "news", "encyclopedia", "forum_social", "unknown")
AUTHORITY_WEIGHT = (1.0, 0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.4, 0.5)
EVIDENCE_WEIGHT = {"study": 1.0, "benchmark": 1.0, "claim": 0.7, "opinion": 0.5, "anecdote": 0.4}
# Owners whose repositories are official, registries, and classes by kind of source.
OFFICIAL_OWNERS = ("nodejs", "microsoft", "denoland", "anthropics")
REGISTRIES = ("npmjs.com", "pypi.org", "crates.io", "rubygems.org")
CLASS_OF_KIND = {
    "official_docs": "official_spec", "documentation": "vendor_sdk_docs", "wikipedia": "encyclopedia", "reddit": "forum_social",
    "hackernews": "forum_social", "stackoverflow": "forum_social", "youtube": "forum_social", "forum": "forum_social", "social": "forum_social",
    "news": "news", "gdelt": "news", "vendor_docs": "vendor_sdk_docs", "package_registry": "package_registry",
}


def authority_of(url: Column, kind: Column) -> Column:
    """A class by host and path, else by the kind of source."""
    host = host_of(url)
    steps = F.filter(F.split(_part(url, 3), "/"), lambda p: p != "")
    kinds = F.create_map(*[F.lit(x) for pair in CLASS_OF_KIND.items() for x in pair])
    return (
        F.when((host == "github.com") & (F.size(steps) >= 2), F.when(F.get(steps, F.lit(0)).isin(*OFFICIAL_OWNERS), F.lit("official_repo")).otherwise(F.lit("third_party_analysis")))
        .when(host.isin(*REGISTRIES), F.lit("package_registry"))
        .when((host == "wikipedia.org") | host.endswith(".wikipedia.org"), F.lit("encyclopedia"))
        .otherwise(F.coalesce(F.try_element_at(kinds, kind), F.lit("third_party_analysis")))
    )


def kind_of(url: Column, fallback: Column) -> Column:
    """The kind of source that the host suggests."""
    host = host_of(url)
    return (
        F.when(host == "github.com", F.lit("github"))
        .when(host.isin("npmjs.com", "pypi.org", "crates.io"), F.lit("package_registry"))
        .when(host == "wikipedia.org", F.lit("wikipedia"))
        .when((host == "stackoverflow.com") | host.contains("stackexchange"), F.lit("stackoverflow"))
        .when(host.isin("reddit.com", "old.reddit.com"), F.lit("reddit"))
        .when(host == "news.ycombinator.com", F.lit("hackernews"))
        .when((host == "arxiv.org") | host.contains("semanticscholar"), F.lit("academic"))
        .when(host.isin("youtube.com", "youtu.be"), F.lit("youtube"))
        .when((host == "docs.google.com") | host.contains("documentation"), F.lit("documentation"))
        .otherwise(fallback)
    )


def authority_rank(name: Column) -> Column:
    """0 best; a missing class comes after all."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, AUTHORITY)), name).cast("int") - 1, F.lit(len(AUTHORITY)))


def authority_weight(name: Column) -> Column:
    rank = F.array_position(F.array(*map(F.lit, AUTHORITY)), name).cast("int")
    return F.coalesce(F.when(rank > 0, F.element_at(F.array(*map(F.lit, AUTHORITY_WEIGHT)), F.greatest(rank, F.lit(1)))), F.lit(0.5))


def freshness(published: Column, as_of: Column, half_life_days: float = 365.25, floor: float = 0.5) -> Column:
    """Halves each half-life, not below the floor; age is at least 0."""
    age = F.greatest((F.unix_timestamp(as_of) - F.unix_timestamp(published)) / 86400.0, F.lit(0.0))
    return F.greatest(F.lit(floor), F.pow(F.lit(0.5), age / half_life_days))
