"""Reconciliation in order against a fold of whole families, and with claims dealt out against one task's work."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from mossgraph.operators import ordered, reconcile

SCHEMA = "id long, family_id string, subject string, predicate string, object string, polarity string, hedge string, value double, unit string, event_date string, version string, entity_id string"


def made(seed, n=150, families=3):
    """Assertions that repeat, refine, deny and replace each other; most are of one family."""
    rng = random.Random(seed)
    subjects = ["the new library", "library two", "Old Library", "a parser", "the parser of the new library", "cache"]
    predicates = ["supports", "uses", "replaces"]
    objects = [None, "json input", "json input and output", "yaml", "only json input", "json input deprecated", "large files of any kind in one pass", "large files of any kind in two passes"]
    rows = []
    for k in range(n):
        number = rng.random() < 0.3
        rows.append((
            k, "f0" if rng.random() < 0.7 else f"f{rng.randrange(families)}", rng.choice(subjects), rng.choice(predicates), rng.choice(objects), rng.choice(["positive"] * 5 + ["negative", "conditional"]), rng.choice(["certain", "likely"]),
            rng.choice([1.0, 1.05, 3.0]) if number else None, rng.choice(["s", "ms"]) if number else None, rng.choice([None] * 4 + ["2023-01-01", "2024-01-01"]), rng.choice([None] * 4 + ["1.0", "v2.1"]), rng.choice([None] * 3 + ["e1", "e2"]),
        ))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_folded_side_by_side_give_what_a_fold_of_whole_families_does(spark, seed):
    frame = spark.createDataFrame(made(seed), SCHEMA).repartition(4)
    got = {r.observation_id: r for r in ordered.plan_ladder(frame, "id").collect()}
    rows = [r.asDict() for r in ordered.described(frame).collect()]
    families = collections.defaultdict(lambda: ordered.Claims(False))
    want = {r["id"]: families[r["family_id"]].observe(r) for r in sorted(rows, key=lambda r: r["id"])}
    assert len(got) == len(rows)
    for k, (kind, score, method, matched, canonical) in want.items():
        assert (got[k].classification, got[k].score, got[k].method, got[k].matched_claim_id, got[k].canonical_claim_id) == (kind, score, method, matched, canonical), k
    kinds = collections.Counter(w[0] for w in want.values())
    assert {"same_claim", "near_duplicate", "contradiction", "qualification", "elaboration", "new_claim"} <= set(kinds)


def test_a_ladder_step_is_the_batch_form_s(spark):
    """One observation against one claim: the fold and the column expressions agree on class, score and method."""
    rows = made(5, 120)
    claims = [(r[0] + 1000, f"g{r[0]}", *rows[(r[0] * 7 + 3) % len(rows)][2:]) for r in rows]
    observations = [(r[0], f"g{r[0]}", *r[2:]) for r in rows]
    pool = spark.createDataFrame(claims, SCHEMA)
    batch = {r.observation_id: r for r in reconcile.plan_batch(spark.createDataFrame(observations, SCHEMA), pool).collect()}
    described = {r["id"]: r.asDict() for r in ordered.described(spark.createDataFrame(observations + claims, SCHEMA)).collect()}
    for k in (r[0] for r in rows):
        claims_of = ordered.Claims(True)
        claims_of.add(described[k + 1000])
        kind, score, method, *_ = claims_of.observe(described[k])
        assert (batch[k].classification, batch[k].score, batch[k].method) == (kind, score, method), k


def test_components_do_not_grow_into_families(spark):
    rows = [(k, "f", f"subject s{k}", "is", f"object o{k}", "positive", "certain", None, None, None, None, None) for k in range(200)]
    rows += [(k, "f", "same thing", "has", "value", "positive", "certain", None, None, None, None, None) for k in range(200, 260)]
    frame = spark.createDataFrame(rows, SCHEMA)
    sizes = ordered.tied(ordered.described(frame)).groupBy("component").count()
    assert sizes.count() == 201 and sizes.agg(F.max("count")).first()[0] == 60
    got = ordered.plan_ladder(frame, "id")
    assert got.where("classification = 'same_claim'").count() == 59 and got.where("canonical_claim_id = 'claim_200'").count() == 60
    assert ordered.plan_ladder(frame.limit(0), "id").count() == 0


def test_scenarios_side_by_side(spark):
    rows = made(7, 80)
    schema = "scenario long, seed boolean, gold string, " + SCHEMA.replace("family_id string, ", "")
    frame = spark.createDataFrame([(r[0] % 4, r[0] < 8, f"{r[2]}|{r[3]}", r[0], *r[2:]) for r in rows], schema)
    got = {r.scenario: (r.n, r.precision, r.recall, r.f1) for r in ordered.scenario_scores(frame, "id").collect()}
    described = {r["id"]: r.asDict() for r in ordered.described(frame.withColumn("family_id", F.lit("x"))).collect()}
    for scenario in range(4):
        claims, pairs = ordered.Claims(True), []
        for r in (r for r in rows if r[0] % 4 == scenario):
            if r[0] < 8:
                claims.add(described[r[0]])
            else:
                pairs.append((claims.observe(described[r[0]])[4], f"{r[2]}|{r[3]}"))
        cell, pred, gold = collections.Counter(pairs), collections.Counter(p for p, _ in pairs), collections.Counter(g for _, g in pairs)
        p = sum(cell[x] / pred[x[0]] for x in pairs) / len(pairs)
        r = sum(cell[x] / gold[x[1]] for x in pairs) / len(pairs)
        assert got[scenario] == (len(pairs), round(p, 6), round(r, 6), round(2 * p * r / (p + r), 6))


def test_a_large_family_is_dealt_out_and_gives_the_same(spark):
    frame = spark.createDataFrame(made(9, 200), SCHEMA).cache()
    asked = frame.where("id % 10 = 0")
    one, many = reconcile.plan_batch(asked, frame), reconcile.plan_batch(asked, frame, least=15)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    blocks = reconcile.paired(asked, frame, 15).where("o_family_id = 'f0'").groupBy("_block").count().collect()
    whole = reconcile.paired(asked, frame).where("o_family_id = 'f0'").count()
    assert len(blocks) > 5 and sum(b["count"] for b in blocks) == whole and max(b["count"] for b in blocks) < whole / 3
