"""Queries over whole tables, against brute force, with ids beyond the bounds of the SQL."""

import collections
import itertools

from mossgraph.catalog import QUERIES


def test_contradictions_read_all_parts(spark, tmp_path):
    words = "alpha beta gamma delta omega".split()
    parts = [(k, f"{words[k % 5]} {words[k // 5 % 5]}", f"{words[k // 3 % 5]} {words[k // 7 % 5]}") for k in [*range(1, 20), *range(290, 340)]]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    sets = [(k, {*f"{n} {t}".split(), *[["not"], ["increases"], ["decreased"], []][k % 4]}) for k, n, t in parts]
    want = []
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        score = round(len(x & y) / len(x | y), 6)
        shared = a % 3 == b % 3 or a % 5 == b % 5
        if shared and score > 0.3 and (a % 4 == 0) != (b % 4 == 0):
            want.append((a, b, "negation"))
        elif not shared and score > 0.35 and {a % 4, b % 4} == {1, 2}:
            want.append((a, b, "direction"))
    got = sorted(tuple(r) for r in QUERIES["al20_contradictions_whole"](spark, str(tmp_path)).select("a", "b", "kind").collect())
    assert got == sorted(want) and any(a >= 300 for a, _, _ in want)


def test_independent_sources_read_all_line_items(spark, tmp_path):
    lines = [(k, k * 7 % 101, k * 11 % 97) for k in [*range(1, 60), *range(395, 460)]]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    claims = collections.defaultdict(list)
    for k, s, p in lines:
        claims[k % 50].append({f"d{s % 13}", *([f"c{p % 29}"] if p % 3 else [])})
    want = {}
    for claim, groups in claims.items():
        apart = []
        for g in groups:
            near = [h for h in apart if h & g]
            apart = [h for h in apart if not h & g] + [g.union(*near)]
        want[claim] = len(apart)
    assert {r.claim_id: r.n_independent for r in QUERIES["ag05_independent_sources_whole"](spark, str(tmp_path)).collect()} == want
