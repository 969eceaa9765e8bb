"""Nearest neighbours against all cosines."""

import numpy as np
import pytest

from mossgraph.operators import cluster, neighbours


def brute(queries, rows, k):
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    norms = np.linalg.norm(v, axis=1, keepdims=True)
    v = np.divide(v, norms, out=np.zeros_like(v), where=norms > 0)
    out = []
    for q in queries:
        at = int(np.flatnonzero(ids == q)[0])
        scores = np.round(v @ v[at], 9)
        scores[at] = -9
        for place, j in enumerate(np.lexsort((ids, -scores))[: min(k, len(ids) - 1)], 1):
            out.append((q, int(ids[j]), round(float(scores[j]), 6), place))
    return sorted(out)


@pytest.mark.parametrize(("seed", "clustered"), [(1, True), (2, False)])
def test_all_neighbours_are_found(spark, monkeypatch, seed, clustered):
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 12))
    v = centres[rng.integers(0, 6, 400)] + 0.2 * rng.normal(size=(400, 12)) if clustered else rng.normal(size=(400, 12))
    v[5], v[6], v[7] = v[4], v[4], 0  # ties and a vector of zeros
    rows = [(int(k), [float(x) for x in v[k]]) for k in range(400)]
    frame = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5)
    got = neighbours.nearest(frame.where("id % 25 = 0 or id in (4, 5, 7)"), frame, 7).collect()
    want = brute([k for k in range(400) if k % 25 == 0 or k in (4, 5, 7)], rows, 7)
    assert sorted((r.query, r.id, round(r.score, 6), r.place) for r in got) == want


def test_nulls_other_lengths_few_rows_and_none(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0]), (5, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = neighbours.nearest(frame, frame, 5).collect()
    assert sorted((r.query, r.id, r.place) for r in got) == [(1, 2, 2), (1, 5, 1), (2, 1, 2), (2, 5, 1), (5, 1, 1), (5, 2, 2)]
    assert neighbours.nearest(frame.limit(0), frame.limit(0), 3).count() == 0


def test_edges_between_claims_by_their_vectors(spark):
    rows = [(1, "alpha beta", "is", None, [1.0, 0.1, 0.0]), (2, "gamma delta", "has", None, [1.0, 0.0, 0.1]), (3, "epsilon", "runs", None, [0.0, 1.0, 0.0])]
    claims = spark.createDataFrame(rows, "id long, subject string, predicate string, object string, embedding array<double>")
    pairs = neighbours.nearest(claims, claims, 2).selectExpr("query as a", "id as b")
    got = cluster.claim_edges(claims, pairs).collect()
    assert [(r.a, r.b, r.method) for r in got] == [(1, 2, "vector")]


def test_memory_of_a_comparison_is_bounded(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(4000, 8)), rng.normal(size=(1000, 8))
    tracemalloc.start()
    parts = list(neighbours._compared(np.arange(4000), a, np.arange(1000), b, 5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, parts)) == 20_000 and peak < 16e6  # all scores at once are 32 MB, and as much again in order
    rows = parts[0][parts[0]["query"] == 7]
    scores = np.round(a[7] @ b.T, 9)
    scores[7] = -np.inf
    assert list(rows["id"]) == list(np.lexsort((np.arange(1000), -scores))[:5])


def test_the_query_asks_for_the_neighbours_of_all_rows(spark, tmp_path):
    from mossgraph.catalog import QUERIES

    rng = np.random.default_rng(7)
    centres = rng.normal(size=(9, 12))
    v = centres[rng.integers(0, 9, 90)] + 0.1 * rng.normal(size=(90, 12))
    rows = [(1001 + k, [float(x) for x in v[k]], "x") for k in range(90)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["al04_vector_edges"](spark, str(tmp_path)).collect()
    want = {(min(q, r), max(q, r)) for q, r, score, _ in brute([r[0] for r in rows], [r[:2] for r in rows], 8) if score >= 0.82}
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) > 100 and {r.method for r in got} == {"vector"}
