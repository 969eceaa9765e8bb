"""Families of events: by odd payloads, and each payload parsed once; changes of a family."""

import json

from mossgraph.api import Knowledge
from mossgraph.operators import feeds

CLAIMS = [("c1", "f1"), ("c2", "f2"), ("c3", "f1"), ("c4", None)]
EVENTS = [
    (1, '{"familyId":"f7","claimId":"c1"}'), (2, '{"f\\u0061milyId":"f8"}'), (3, '{"cl\\u0061imId":"c2"}'), (4, '{"claimIdA":"c1","claimIdB":"c3"}'), (5, '{"sourceClaimId":"c1","survivorClaimId":"c2"}'),
    (6, '{"observation":{"familyId":"f5"},"reconciliation":{"canonicalClaimId":"c3"}}'), (7, '{"claimId":"c4"}'), (8, None), (9, '{"id":"c1","note":"familyId claimId"}'), (10, '{"familyId":null,"family_id":12,"relatedClaimId":"none"}'), (11, '{}'),
]


def _tables(spark):
    return spark.createDataFrame(EVENTS, "seq long, payload string"), spark.createDataFrame(CLAIMS, "claim_id string, family_id string")


def brute(events, claims):
    known, out = dict(claims), set()
    for seq, payload in events:
        p = json.loads(payload or "{}")
        own = next((str(v) for v in (p.get("familyId"), p.get("family_id"), p.get("observation", {}).get("familyId")) if v is not None), None)
        named = [p.get(n) for n in ("claimId", "claimIdA", "claimIdB", "sourceClaimId", "survivorClaimId", "fromClaimId", "toClaimId", "relatedClaimId")] + [p.get("reconciliation", {}).get("canonicalClaimId")]
        out |= {(seq, f) for f in (own, *[known.get(c) for c in named]) if f is not None}
    return sorted(out)


def test_owning_families_of_odd_payloads(spark):
    assert sorted(tuple(r) for r in feeds.owning_families(*_tables(spark)).collect()) == brute(EVENTS, CLAIMS)


def test_owning_families_parse_a_payload_once_a_side(spark):
    plan = feeds.owning_families(*_tables(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") + plan.count("parse_json") == 2


def test_changes_of_a_family_meet_the_log_by_the_first_places_only(spark):
    events, claims = _tables(spark)
    log = events.selectExpr("seq", "'CLAIM_OBSERVED' as event_type", "payload")
    log = log.union(log.where("seq = 4"))  # a place that two rows have
    asked = Knowledge({"claims": claims.withColumnRenamed("claim_id", "id")}, log)
    places = [seq for seq, f in brute(EVENTS, CLAIMS) if f == "f1" and seq > 1]
    wanted = sorted([*places, *[4 for p in places if p == 4]])
    for limit in (1, 2, 3, 100):
        found = asked.ask("changes", since=1, family_id="f1", limit=limit)
        assert [r.seq for r in found.collect()] == wanted[:limit]
        assert limit == 100 or found._jdf.queryExecution().optimizedPlan().toString().count("GlobalLimit") >= 2
