"""The state of a claim against rules worked out claim by claim."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from mossgraph.functions.addresses import AUTHORITY, AUTHORITY_WEIGHT, EVIDENCE_WEIGHT
from mossgraph.functions.text import opposed
from mossgraph.operators import epistemics, resolve

AS_OF = "2024-06-01"
OBS = "id string, claim_id long, confidence double, evidence_type string, authority_class string, observed_at string, source_ids array<string>, status string"
EVI = "id string, claim_id long, source_id string, observation_id string, stance string, excerpt string"
SRC = "id string, domain string, authority_class string, published_at string, retrieved_at string, content_hash string"


def made(seed, n=40):
    rng = random.Random(seed)
    day = lambda: rng.choice([None, f"202{rng.randrange(5)}-0{rng.randrange(1, 10)}-11"])
    sources = [(f"s{k}", rng.choice(["a.x", "b.x", "c.x", "", None]), rng.choice([None, *AUTHORITY]), day(), day(), rng.choice([None, "h1", "h2"])) for k in range(12)]
    ids = [s[0] for s in sources] + ["unknown"]
    observations = [
        (f"o{k:03}", rng.randrange(n), round(rng.random(), 3), rng.choice(list(EVIDENCE_WEIGHT)), rng.choice([None, None, "news"]), f"2023-0{rng.randrange(1, 10)}-01", rng.sample(ids, rng.randrange(0, 3)), rng.choice([None, "active", "retracted"]))
        for k in range(n * 2)
    ]
    evidence = [(f"e{k:03}", rng.randrange(n), rng.choice(ids), rng.choice([None, "none", *[o[0] for o in observations]]), rng.choice(["supports", "opposes", "context", None]), rng.choice([None, "", "t1", "t2"])) for k in range(n * 2)]
    contradictions = [(rng.randrange(n), rng.randrange(n), rng.choice([None, "unresolved", "resolved", "explained"])) for _ in range(n // 4)]
    return n, sources, observations, evidence, contradictions


def state_of(claim, sources, observations, evidence, contradictions):
    by_id = {s[0]: s for s in sources}
    weight = dict(zip(AUTHORITY, AUTHORITY_WEIGHT, strict=True))
    obs = [o for o in observations if o[1] == claim and o[7] != "retracted"]
    gone = {o[0] for o in observations if o[7] == "retracted"}
    evi = [e for e in evidence if e[1] == claim and e[3] not in gone]
    records = [c[2] or "unresolved" for c in contradictions if claim in c[:2]]
    sup, opp = [sum(e[4] == s for e in evi) for s in ("supports", "opposes")]
    state = "contested" if "unresolved" in records else "resolved" if records else "contested" if sup and opp else "none"
    authority = lambda o: weight.get(o[4] or next((by_id[s][2] for s in o[6] if s in by_id and by_id[s][2]), None), 0.5)

    def fresh(o):
        dates = [by_id[s][3] or by_id[s][4] for s in o[6] if s in by_id]
        at = max((d for d in dates if d), default=o[5])
        age = max(0, (datetime.date.fromisoformat(AS_OF) - datetime.date.fromisoformat(at)).days)
        return max(0.5, 0.5 ** (age / 365.25))

    ws = [authority(o) * EVIDENCE_WEIGHT[o[3]] * fresh(o) for o in obs]
    base = sum(w * o[2] for w, o in zip(ws, obs)) / sum(ws) if obs else 0
    if opp and (sup or obs):
        against = sum(weight.get(by_id[e[2]][2], 0.5) if e[2] in by_id else 0.5 for e in evi if e[4] == "opposes")
        base *= 1 - min(against / max(sup, 1), 0.8)
    used = {s for o in obs for s in o[6]} | {e[2] for e in evi}
    groups = []
    for s in used:
        if s in by_id and by_id[s][1]:
            content = by_id[s][5] or next((e[5] for e in sorted(evi) if e[2] == s and e[5]), None)
            mine = {("d", by_id[s][1])} | ({("c", content)} if content else set())
            tied = [g for g in groups if g & mine]
            groups = [g for g in groups if not g & mine] + [set().union(mine, *tied)]
    status = "unknown" if not obs else "contested" if state == "contested" else "consensus" if len(obs) >= 2 and len(groups) >= 2 else "emerging" if evi or len(obs) >= 2 else "speculative"
    best = max(map(authority, obs), default=0)
    support = "conflicting" if state == "contested" else "weak" if not obs else "primary" if best >= 0.85 else "secondary" if best >= 0.6 else "weak"
    return round(base, 3), state, support, status, len(groups)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_states_as_worked_out_claim_by_claim(spark, seed):
    n, sources, observations, evidence, contradictions = made(seed)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = epistemics.epistemic_state(frame([(k,) for k in range(n)], "id long"), frame(observations, OBS), frame(evidence, EVI), frame(sources, SRC), frame(contradictions, "claim_a long, claim_b long, status string"), AS_OF).collect()
    assert len(got) == n and {r.contradiction_state for r in got} == {"contested", "resolved", "none"}
    for r in got:
        confidence, *rest = state_of(r.claim_id, sources, observations, evidence, contradictions)
        assert tuple(r)[2:] == tuple(rest), r
        assert abs(r.confidence - confidence) <= 0.001 + 1e-9


def test_directions_are_found_within_words(spark):
    pairs = [("prices increases", "price decreases"), ("it grows", "it shrank"), ("shrinks", "outgrown"), ("more", "lessons"), ("same", "same")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(opposed(F.col("a"), F.col("b"))).collect()]
    assert got == [True, False, True, True, False]
    findings = [(1, [1, 2], "the rate of growth increases every year now"), (2, [3], "the rate of growth decreases every year now"), (3, [2, 9], "the rate of growth does not increases every year now"), (4, [2], "something else entirely")]
    found = resolve.contradictions(spark.createDataFrame(findings, "id long, questions array<long>, text string"))
    assert sorted(map(tuple, found.collect())) == [(1, 2, "direction"), (1, 3, "negation"), (2, 3, "direction")]


def test_independent_sources_of_small_claims_take_no_rounds(spark, monkeypatch):
    import random

    from mossgraph.operators import epistemics

    seed = random.Random(3)
    links = [(c, seed.choice([None, *"uvwxyz"]), seed.choice([None, *range(6)])) for c in [*range(40), None] for _ in range(seed.randint(1, 7))]
    crowd = [(99, f"d{k}", f"{k // 2 if k % 3 else k // 2 + 1}") for k in range(epistemics.SMALL + 20)]
    links = [(c, d, None if t is None else str(t)) for c, d, t in links] + crowd
    want = {}
    for claim in {c for c, d, _ in links if d is not None}:
        groups = []
        for names in ({("d", d)} | ({("c", t)} if t is not None else set()) for c, d, t in links if c == claim and d is not None):
            met = [g for g in groups if g & names]
            groups = [g for g in groups if not g & names] + [names.union(*met)]
        want[claim] = len(groups)
    sent = []
    monkeypatch.setattr(epistemics, "components", lambda edges, f=epistemics.components: sent.append(edges.count()) or f(edges))
    frame = spark.createDataFrame(links, "claim_id long, domain string, content string")
    assert {r.claim_id: r.n_independent for r in epistemics.independent_sources(frame).collect()} == want
    assert len(sent) == 1 and 0 < sent[0] <= len(crowd)
    few = frame.where("claim_id < 40")
    assert {r.claim_id: r.n_independent for r in epistemics.independent_sources(few).collect()} == {k: v for k, v in want.items() if k is not None and k < 40}
    assert len(sent) == 1
