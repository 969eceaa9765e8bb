"""Searches in the stored index against a matcher over the texts themselves."""

import random
import re
import unicodedata

import pytest

from mossgraph.operators.search import SearchIndex, folded, spelled

QUERIES = [
    "cafe", "Café", "CAFÉ au", '"café au lait"', "caf*", "title:cafe", 'title:"au lait"', "cafe NOT lait", "tea OR coffee", "cafe OR tea lait", '"au la*', "b1", "nothing", "naïve", "don't", "İstanbul", "ö", "t*", '"au lait"*',
]


def plain(text):
    return "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not unicodedata.category(c).startswith("M"))


def words(text):
    return [w for w in re.split(r"[\W_]+", plain(text)) if w]


def matched(row, term):
    field = None
    if ":" in term:
        field, term = term.split(":", 1)
    star, parts = term.endswith("*"), words(term)
    for name, text in row.items():
        if field in (None, name):
            ws = words(text)
            for k in range(len(ws) - len(parts) + 1):
                if all((w.startswith(p) if star and i == len(parts) - 1 else w == p) for i, (w, p) in enumerate(zip(ws[k:], parts))):
                    return True
    return False


def brute(rows, query):
    """All groups of terms tied by OR must match, and no term after NOT."""
    terms = re.findall(r'(?:\w+:)?"[^"]*"\*?|[^\s"]+', query)
    groups, nots, k = [], [], 0
    while k < len(terms):
        if terms[k] == "NOT":
            nots.append(terms[k + 1])
            k += 2
        elif terms[k] == "OR":
            groups[-1].append(terms[k + 1])
            k += 2
        else:
            groups.append([terms[k]])
            k += 1
    return sorted(key for key, row in rows.items() if all(any(matched(row, t) for t in g) for g in groups) and not any(matched(row, t) for t in nots))


def rows_of(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["Café", "cafe", "au", "lait", "tea", "coffee", "b1", "naïve", "naive", "don't", "İstanbul", "istanbul", "Ö", "o", "été", "thé,", "x-y"]
    return {f"k{k}": {"title": " ".join(rng.choices(vocabulary, k=rng.randrange(5))), "body": " ".join(rng.choices(vocabulary, k=rng.randrange(9)))} for k in range(n)}


def frame(spark, rows):
    return spark.createDataFrame([(k, r["title"], r["body"], 1) for k, r in rows.items()], "id string, title string, body string, word int")


def test_searches_before_and_after_updates(spark, tmp_path):
    rows = rows_of(1)
    SearchIndex(spark, f"{tmp_path}/i", buckets=4).update(frame(spark, rows), "id", ["title", "body"])
    found = SearchIndex(spark, f"{tmp_path}/i")
    for query in (q for q in QUERIES if q.count('"') % 2 == 0):
        assert sorted(r.key for r in found.search(query).collect()) == brute(rows, query), query
    changed = {k: r for k, r in rows_of(2).items() if int(k[1:]) % 3 == 0} | {"new": {"title": "café lait", "body": None}}
    gone = spark.createDataFrame([("k1",), ("k2",)], "id string")
    found.update(frame(spark, changed), "id", ["title", "body"], gone)
    rows = {k: r for k, r in (rows | changed).items() if k not in ("k1", "k2")}
    for query in ("cafe", "caf* lait", "tea OR coffee", '"au lait"', "t*"):
        assert sorted(r.key for r in SearchIndex(spark, f"{tmp_path}/i").search(query).collect()) == brute(rows, query), query


def test_a_search_reads_only_the_buckets_of_its_words(spark, tmp_path):
    rows = {f"k{k}": {"title": f"word{k} common", "body": f"other{k % 50} x"} for k in range(800)}
    index = SearchIndex(spark, f"{tmp_path}/i", buckets=64)
    index.update(frame(spark, rows), "id", ["title", "body"])
    assert [r.key for r in index.search("word77").collect()] == ["k77"]
    assert index.rows_read() < 0.1 * index.tables["postings"].rows()
    assert index.search("common NOT other7").count() == 784


@pytest.mark.parametrize("query", ["", "NOT a", "a OR", "OR a", "(a)", '"open', "a NOT", "---"])
def test_what_is_not_understood_is_an_error(spark, tmp_path, query):
    with pytest.raises(ValueError):
        SearchIndex(spark, f"{tmp_path}/none").search(query)


def test_texts_and_queries_are_folded_alike(spark):
    texts = ["Café", "ÀÉÎõü", "Ǆ ǅ", "ΆΈ Ё", "é", "ŁØß", "ÅNGSTRÖM", "ǖ Ấ", "ſ"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(folded("t")).collect()]
    assert [" ".join(spelled(t)) for t in texts] == got
