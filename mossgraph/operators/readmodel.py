"""Queries of the read model: filters, keyset pages, drill-downs and token search."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import unicode_words

PAGE_DEFAULT, PAGE_MOST, SEARCH_MOST = 50, 100, 200


def page_limit(limit: int | None) -> int:
    """50 by default, at most 100; anything but a positive whole number is an error."""
    if limit is None:
        return PAGE_DEFAULT
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 1:
        raise ValueError(f"limit must be a positive whole number, not {limit!r}")
    return min(limit, PAGE_MOST)


def search_text(text: str | None) -> str | None:
    text = (text or "").strip()
    if len(text) > SEARCH_MOST:
        raise ValueError(f"search text is longer than {SEARCH_MOST} characters")
    return text or None


def encode_cursor(kind: str, key: list) -> str:
    return base64.urlsafe_b64encode(json.dumps({"v": 1, "kind": kind, "key": key}, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(kind: str, arity: int, cursor: str) -> list:
    """The key of a cursor; an error for another version, kind, arity or alphabet."""
    if not cursor or any(not (c.isalnum() and c.isascii() or c in "-_") for c in cursor):
        raise ValueError("malformed cursor")
    try:
        found = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError as error:
        raise ValueError("malformed cursor") from error
    if not isinstance(found, dict) or found.get("v") != 1 or found.get("kind") != kind or not isinstance(found.get("key"), list) or len(found["key"]) != arity or not isinstance(found["key"][-1], (str, int)):
        raise ValueError("cursor of another query")
    return found["key"]


def active(rows: DataFrame) -> DataFrame:
    """Rows that have not expired; merged and retracted ones stay."""
    return rows.where(F.col("expired_at").isNull())


def curated(status: Column) -> Column:
    return F.coalesce(status, F.lit("active")) == "active"


def filtered(rows: DataFrame, **wanted) -> DataFrame:
    """Equality on each column that has a wanted value."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    return rows


def related(relations: DataFrame, claim_id, direction: str = "either") -> DataFrame:
    start, end = F.col("from_id") == claim_id, F.col("to_id") == claim_id
    return relations.where({"from": start, "to": end, "either": start | end}[direction])


def after_key(time: str, key: str, cursor: list | None) -> Column:
    """Rows behind ``cursor`` in the order time descending with nulls last, key ascending."""
    if cursor is None:
        return F.lit(True)
    at, last = cursor
    if at is None:
        return F.col(time).isNull() & (F.col(key) > F.lit(last))
    return (F.col(time) < F.lit(at)) | F.col(time).isNull() | ((F.col(time) == F.lit(at)) & (F.col(key) > F.lit(last)))


def page(rows: DataFrame, time: str = "last_seen_at", key: str = "id", limit: int | None = None, cursor: list | None = None) -> DataFrame:
    """One page; ask for one row more to know whether another follows."""
    return rows.where(after_key(time, key, cursor)).orderBy(F.col(time).desc_nulls_last(), F.col(key).asc()).limit(page_limit(limit))


def token_index(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(key, field, pos, token)``: the inverted index of some text columns, without accents' case."""
    parts = [rows.select(F.col(key).alias("key"), F.lit(f).alias("field"), F.posexplode(F.split(unicode_words(F.coalesce(F.col(f), F.lit(""))), " ")).alias("pos", "token")) for f in fields]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("token <> ''")


def matching(index: DataFrame, query: str) -> DataFrame:
    """Keys that match all terms of ``query``: words, ``prefix*``, ``"a phrase"``, ``field:word``, ``NOT word``, ``a OR b``."""
    tokens = _terms(query)
    found, negate, either = None, False, False
    for term in tokens:
        if term in ("AND",):
            continue
        if term == "NOT":
            negate = True
            continue
        if term == "OR":
            either = True
            continue
        keys = _term(index, term)
        if found is None:
            if negate:
                raise ValueError("a query cannot begin with NOT")
            found = keys
        elif negate:
            found = found.join(keys, "key", "left_anti")
        elif either:
            found = found.union(keys).distinct()
        else:
            found = found.join(keys, "key", "left_semi")
        negate = either = False
    if found is None or negate or either:
        raise ValueError(f"no terms to search for in {query!r}")
    return found


def _terms(query: str) -> list[str]:
    if query.count('"') % 2 or any(c in query for c in "()^{}+"):
        raise ValueError(f"search syntax is not understood: {query!r}")
    out = []
    for k, part in enumerate(query.split('"')):
        out += [f'"{part}'] if k % 2 else part.split()
    return out


def _term(index: DataFrame, term: str) -> DataFrame:
    if term.startswith('"'):
        words = term[1:].lower().split()
        out = index.where(F.col("token") == words[0]).select("key", "field", "pos")
        for k, word in enumerate(words[1:], 1):
            out = out.join(index.where(F.col("token") == word).select("key", "field", (F.col("pos") - k).alias("pos")), ["key", "field", "pos"], "left_semi")
        return out.select("key").distinct()
    if ":" in term:
        field, term = term.split(":", 1)
        index = index.where(F.col("field") == field)
    term = term.lower()
    hit = F.col("token").startswith(term[:-1]) if term.endswith("*") else F.col("token") == term
    return index.where(hit).select("key").distinct()


def hash_changes(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``(key, old_hash, new_hash)`` where both have a hash and they differ."""
    both = old.select(key, F.col("hash").alias("old_hash")).join(new.select(key, F.col("hash").alias("new_hash")), key)
    return both.where("old_hash is not null and new_hash is not null and old_hash <> new_hash")


def drained(rows: DataFrame, most: int, by: str, key: str = "id") -> DataFrame:
    """The first ``most`` rows of all pages with ``truncated``: whether there are more.  One bounded sort stands for the pages."""
    top = rows.orderBy(F.col(by).desc(), key).limit(most + 1)
    more = top.count() > most
    return top.orderBy(F.col(by).desc(), key).limit(most).withColumn("truncated", F.lit(more))


def run_page(runs: DataFrame, before: int | None = None, limit: int | None = None) -> DataFrame:
    """Runs by the place of their first event, latest first, those before ``before``."""
    rows = runs if before is None else runs.where(F.col("seq") < before)
    return rows.orderBy(F.col("seq").desc()).limit(page_limit(limit))
