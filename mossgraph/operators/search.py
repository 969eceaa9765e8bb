"""Full-text search over a stored index: words with their places, in buckets by word, kept up batch by batch.

Texts and queries are cut into words alike: lower case, without diacritics, runs of letters and digits.  ``postings`` has a row for
every place of a word, in the bucket of the word; ``words`` has every word once, in the bucket of its first letters, and leads from
a prefix to words; ``texts`` has the words of every row, in the bucket of its key, and says what to take away when a row changes.
A search opens the buckets of its words only; it reports how many rows that was.

A query is words, ``prefix*``, ``"a phrase"``, ``field:word``, ``a OR b``, ``NOT word``; terms that follow each other must all match, and
OR binds them tighter.  A word with marks inside is a phrase of its parts.  Anything else is an error.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from ..sources.buckets import Buckets
from .graph import removed, saved

INITIALS = 2
TABLES = {
    "postings": (["word"], "word string, key string, field string, pos int"), "words": (["initials"], "initials string, word string, n long"), "texts": (["key"], "key string, field string, pos int, word string"),
}


@lru_cache
def _plain_letters() -> tuple[str, str]:
    """Small precomposed letters and their base letters, as Unicode decomposes them."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        letter = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", letter) if not unicodedata.combining(c))
        if letter.isalpha() and letter == letter.lower() and len(base) == 1 and base != letter:
            pairs.append((letter, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    """Lower case without diacritics."""
    letters, bases = _plain_letters()
    return F.translate(F.regexp_replace(F.lower(text), r"\p{M}+", ""), letters, bases)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(folded(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def spelled(text: str) -> list[str]:
    """The words of a piece of a query."""
    letters, bases = _plain_letters()
    plain = "".join(c for c in text.lower() if not unicodedata.category(c).startswith("M")).translate(str.maketrans(letters, bases))
    return [w for w in re.split(r"[\W_]+", plain) if w]


class SearchIndex:
    """The index of some text columns under ``folder``; ``update`` brings it up to changed rows."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 8, target: int = 1_000_000):
        self.spark, self.folder = spark, folder.rstrip("/")
        known = json.loads(files.read_text(spark, f"{self.folder}/manifest.json") or "{}")
        self.batch = known.get("batch", -1)
        self.tables = {}
        for name, (keys, schema) in TABLES.items():
            entry = known.get("tables", {}).get(name, {})
            self.tables[name] = Buckets(spark, f"{self.folder}/{name}", keys, schema, entry.get("count", buckets), target, entry.get("entries"))

    def update(self, rows: DataFrame, key: str, fields: list[str], gone: DataFrame | None = None) -> None:
        """Index ``rows`` anew, instead of what was indexed under their keys; keys of ``gone`` are no longer found."""
        number = self.batch + 1
        t = self.tables
        parts = [rows.select(F.col(key).cast("string").alias("key"), F.lit(f).alias("field"), F.posexplode(words_of(F.col(f))).alias("pos", "word")) for f in fields]
        new = parts[0]
        for part in parts[1:]:
            new = new.unionByName(part)
        new = saved(new)
        keys = rows.select(F.col(key).cast("string").alias("key"))
        keys = saved((keys if gone is None else keys.union(gone.select(F.col(key).cast("string")))).where("key is not null").distinct())
        old = saved(t["texts"].lookup(keys))
        t["texts"].replace(keys, new, number)
        pairs = saved(old.select("word", "key").union(new.select("word", "key")).distinct())
        t["postings"].replace(pairs, new, number, on=["word", "key"])
        change = old.select("word", F.lit(-1).alias("n")).union(new.select("word", F.lit(1))).groupBy("word").agg(F.sum("n").alias("n")).where("n <> 0")
        change = saved(change.select(F.left("word", F.lit(INITIALS)).alias("initials"), "word", F.col("n").cast("long").alias("n")))
        counted = t["words"].lookup(change.select("initials")).join(change.select("initials", "word"), ["initials", "word"], "left_semi").unionByName(change).groupBy("initials", "word").agg(F.sum("n").alias("n")).where("n > 0")
        t["words"].replace(change.select("initials", "word"), saved(counted), number, on=["initials", "word"])
        files.write_text(self.spark, f"{self.folder}/manifest.json", json.dumps({"batch": number, "tables": {name: {"count": x.count, "entries": x.entries} for name, x in t.items()}}))
        self.batch = number
        removed(new, keys, old, pairs, change)

    # --- searching ---

    def search(self, query: str) -> DataFrame:
        """``(key)`` of the rows that match."""
        for table in self.tables.values():
            table.rows_read = 0
        found, negate, either, pending = None, False, False, None
        for term in _terms(query):
            if term == "AND":
                continue
            if term == "NOT":
                negate = True
                continue
            if term == "OR":
                either = True
                continue
            keys = self._term(term)
            if either and not negate and pending is not None:
                pending = pending.union(keys).distinct()
            else:
                if pending is not None:
                    found = pending if found is None else found.join(pending, "key", "left_semi")
                    pending = None
                if negate:
                    if found is None:
                        raise ValueError("a query cannot begin with NOT")
                    found = found.join(keys, "key", "left_anti")
                elif either:
                    raise ValueError("OR stands between two terms")
                else:
                    pending = keys
            negate = either = False
        if negate or either or (found is None and pending is None):
            raise ValueError(f"no terms to search for in {query!r}")
        if pending is not None:
            found = pending if found is None else found.join(pending, "key", "left_semi")
        return found

    def rows_read(self) -> int:
        return sum(t.rows_read for t in self.tables.values())

    def _word(self, word: str) -> DataFrame:
        bucket = self.spark.range(1).select(F.lit(word).alias("word"))
        return self.tables["postings"].lookup(bucket)

    def _starting(self, prefix: str) -> DataFrame:
        """Postings of all words with a prefix: the words first, then their buckets."""
        words = self.tables["words"]
        rows = words.lookup(self.spark.range(1).select(F.lit(prefix[:INITIALS]).alias("initials"))) if len(prefix) >= INITIALS else words.read()
        return self.tables["postings"].lookup(rows.where(F.col("word").startswith(prefix)).select("word"))

    def _term(self, term: str) -> DataFrame:
        field, quoted = None, term.startswith('"')
        if not quoted and ":" in term:
            field, term = term.split(":", 1)
            quoted = term.startswith('"')
        prefix = term.endswith("*")
        words = spelled(term.strip('"').rstrip("*"))
        if not words:
            raise ValueError(f"no word in {term!r}")
        places = None
        for k, word in enumerate(words):
            rows = self._starting(word) if prefix and k == len(words) - 1 else self._word(word)
            at = (rows if field is None else rows.where(F.col("field") == field)).select("key", "field", (F.col("pos") - k).alias("pos"))
            places = at if places is None else places.join(at, ["key", "field", "pos"], "left_semi")
        return places.select("key").distinct()


def _terms(query: str) -> list[str]:
    """Words, phrases and operators; a field may stand before a word or a phrase."""
    if query.count('"') % 2 or any(c in query for c in "()^{}+"):
        raise ValueError(f"search syntax is not understood: {query!r}")
    return re.findall(r'(?:\w+:)?"[^"]*"\*?|[^\s"]+', query)
