"""Projections over whole tables, against a fold of the log event by event, with far ids."""

import datetime
import json

from mossgraph.catalog import QUERIES
from mossgraph.plans.model import Model


def test_projections_read_whole_tables(spark, tmp_path):
    folder = str(tmp_path)
    keys = [*range(1, 40), *range(680, 700), *range(1490, 1600), *range(200_000, 200_060)]
    orders = [(k, k % 90, datetime.date(2024, 1, 1 + k % 28)) for k in keys]
    lines = [(k, n, k % 30, "ARN"[(k + n) % 3]) for k in keys for n in (1, 2)]
    events = [(k, k % 37, ("view", "click", "error", "signup", "purchase")[k * k % 5 if k % 3 else k % 5]) for k in [*range(1, 200), *range(4990, 5300)]]
    for name, rows, schema in (
        ("orders", orders, "o_orderkey long, o_custkey long, o_orderdate date"), ("lineitem", lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_returnflag string"),
        ("events", events, "event_id long, user_id long, event_type string"), ("nation", [(k,) for k in range(25)], "n_nationkey long"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    log = [(r.seq, r.run_id, r.event_type, json.loads(r.payload)) for r in Model(spark, folder).klog.orderBy("seq").collect()]
    assert len({e[0] for e in log}) == len(log) == len(orders) + len(lines) + len(events) + 8 + sum(k % 97 in (5, 6, 7, 40) for k in keys) + sum(k % 31 == 3 for k in keys)

    rolled = {p["run_id"] for _, _, kind, p in log if kind == "RUN_ROLLED_BACK"}
    own = {(p["id"], run) for _, run, kind, p in log if kind == "EDGE_ADDED"}
    dropped = lambda run, kind, p: run in rolled and (kind not in ("CLAIM_MERGED", "SOURCE_RETRACTED", "EDGE_REMOVED") or (kind == "EDGE_REMOVED" and (p["edgeId"], run) in own))
    live = [e for e in log if e[2] != "RUN_ROLLED_BACK" and not dropped(*e[1:])]
    run = lambda name, *columns: sorted(tuple(r) for r in QUERIES[name](spark, folder).select(*columns).collect())
    assert run("rep04_live_events_whole", "seq", "run_id", "event_type") == sorted(e[:3] for e in live)

    into = {p["claimId"]: p["intoClaimId"] for _, _, kind, p in live if kind == "CLAIM_MERGED"}
    last = lambda c: last(into[c]) if c in into else c
    assert run("pj16_survivors_whole", "id", "survivor") == sorted((c, last(c)) for c in into)

    seen, linked, sources, edges = {}, {}, {}, {}
    for _, _, kind, p in live:
        if kind == "CLAIM_OBSERVED":
            seen.setdefault(last(p["claimId"]), []).append(p)
        elif kind == "EVIDENCE_LINKED":
            linked[p["id"]] = p
        elif kind == "SOURCE_OBSERVED":
            sources.setdefault(p["sourceId"], []).append(p)
        elif kind == "EDGE_ADDED":
            edges[p["id"]] = p
        elif kind == "EDGE_REMOVED":
            edges.pop(p["edgeId"], None)
    count = lambda c, stance: sum(last(p["claimId"]) == c and p["stance"] == stance for p in linked.values())
    assert run("pj06_claims_whole", "id", "family_id", "n_observations", "last_seen_at", "n_supports", "n_opposes") == sorted(
        (c, s[0]["familyId"], len(s), max(p["observedAt"] for p in s), count(c, "supports"), count(c, "opposes")) for c, s in seen.items())
    gone = {p["sourceId"] for _, _, kind, p in live if kind == "SOURCE_RETRACTED"}
    assert run("pj12_sources_whole", "id", "url", "run_count", "last_seen_at", "retracted") == sorted((k, s[0]["url"], len(s), s[-1]["observedAt"], k in gone) for k, s in sources.items())
    assert run("pj14_edges_whole", "id", "from_id", "to_id") == sorted((k, p["fromClaimId"], p["toClaimId"]) for k, p in edges.items() if p["fromClaimId"] != p["toClaimId"])
