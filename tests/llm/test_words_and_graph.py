import itertools
import random

import numpy as np

from mossgraph.llm.graph import connected_components
from mossgraph.llm.words import word_hashes


def test_words_are_split_and_hashed_alike():
    texts = ["The the\tTHE\x0bx", None, "", "  \n", "é É e f", "a" * 70_000 + " b"]
    hashes, at = word_hashes(texts)
    split = [(t or "").encode().lower().split() for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in split]
    by = {}
    for word, h in zip(itertools.chain(*split), hashes.tolist(), strict=True):
        assert by.setdefault(word, h) == h
    assert len(set(by.values())) == len(by)


def test_components(spark):
    random.seed(4)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)] + [(5, 5), (None, 3), (7, None)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_what_the_driver_holds_for_a_join_goes_with_it(spark, monkeypatch):
    import os

    from mossgraph.llm import jaccard_join

    sent = []
    context = type(spark.sparkContext)
    monkeypatch.setattr(context, "broadcast", lambda self, value, f=context.broadcast: sent.append(f(self, value)) or sent[-1])
    docs = spark.createDataFrame([(k, f"a b c d e f g {k // 3}") for k in range(12)], "doc_id long, text string")
    groups = {r.doc_id: r.component_id for r in jaccard_join.link_groups(docs, 3, 90, 100).collect()}
    assert groups == {k: k // 3 * 3 for k in range(12)}
    assert sent and not any(os.path.exists(b._path) for b in sent)
