"""Views kept up by deltas against a rebuild of the whole log, batch after batch."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mossgraph.operators import projection
from mossgraph.sources import files
from mossgraph.streaming import incremental
from mossgraph.streaming.incremental import Incremental

SCHEMA = "seq long, run_id string, event_type string, payload string"


def made(n, seed, first=1, claims=40, runs=12):
    """Events of all kinds, with merges, chains and cycles of merges, rollbacks, and events of runs that are rolled back already."""
    rng = random.Random(seed)
    c = lambda: f"c{rng.randrange(claims)}"
    out = []
    for seq in range(first, first + n):
        kind = rng.choices(["CLAIM_OBSERVED", "EVIDENCE_LINKED", "CLAIM_MERGED", "CLAIM_EXPIRED", "SOURCE_OBSERVED", "SOURCE_READ", "SOURCE_RETRACTED", "EDGE_ADDED", "EDGE_REMOVED", "RUN_ROLLED_BACK", "RUN_PROGRESS", "NODE_ADDED"], [30, 30, 4, 3, 12, 6, 1, 10, 6, 1, 3, 2])[0]
        body = {
            "CLAIM_OBSERVED": lambda: {"claimId": c(), "familyId": f"f{rng.randrange(5)}", "subject": f"s{seq}", "observedAt": f"2024-{rng.randrange(10, 99)}"},
            "EVIDENCE_LINKED": lambda: {"id": f"e{rng.randrange(60)}", "claimId": c(), "stance": rng.choice(["supports", "opposes", "context"])},
            "CLAIM_MERGED": lambda: {"claimId": c(), "intoClaimId": c()}, "CLAIM_EXPIRED": lambda: {"claimId": c(), "expiredAt": f"x{seq}"},
            "SOURCE_OBSERVED": lambda: {"sourceId": f"s{rng.randrange(15)}", "url": f"u{seq}", "domain": "d", "observedAt": f"t{seq}"} | ({"authorityClass": rng.choice("ab")} if rng.random() < 0.4 else {}),
            "SOURCE_READ": lambda: {"sourceId": f"s{rng.randrange(20)}"} | ({"contentHash": f"h{seq}"} if rng.random() < 0.6 else {}), "SOURCE_RETRACTED": lambda: {"sourceId": f"s{rng.randrange(20)}"},
            "EDGE_ADDED": lambda: {"id": f"g{rng.randrange(20)}", "fromClaimId": c(), "toClaimId": c(), "relation": "r"}, "EDGE_REMOVED": lambda: {"edgeId": f"g{rng.randrange(20)}"},
            "RUN_ROLLED_BACK": lambda: {"run_id": f"r{rng.randrange(runs)}"}, "RUN_PROGRESS": dict, "NODE_ADDED": lambda: {"id": "n"},
        }[kind]()
        out.append((seq, f"r{rng.randrange(runs)}", kind, json.dumps(body)))
    return out


def same(store, log):
    for name, want in projection.rebuilt(log).items():
        got = store.views()[name]
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())), name


def test_equal_to_a_rebuild_after_each_of_ten_batches(spark, tmp_path):
    events = made(600, 1)
    store, sizes = Incremental(spark, f"{tmp_path}/store", buckets=4, target=10**6), [3, 60, 100, 7, 100, 80, 100, 1, 99, 50]
    assert sum(sizes) == 600 and sum(e[2] == "RUN_ROLLED_BACK" for e in events) > 3 and sum(e[2] == "CLAIM_MERGED" for e in events) > 10
    at = 0
    for size in sizes:
        store.apply(spark.createDataFrame(events[at : at + size], SCHEMA))
        at += size
        same(store, spark.createDataFrame(events[:at], SCHEMA))
    assert store.sound() and store.cursor == 600


def test_a_batch_reads_what_it_affects(spark, tmp_path):
    """On a store a hundred times as large a batch of the same kind reads about as many rows, but for the size of buckets."""
    log = [(k, f"r{k % 900}", "CLAIM_OBSERVED", json.dumps({"claimId": f"c{k}", "familyId": "f", "subject": "s", "observedAt": "t"})) for k in range(1, 3001)]
    log += [(k, f"r{k % 900}", "EVIDENCE_LINKED", json.dumps({"id": f"e{k}", "claimId": f"c{k - 9000}", "stance": "supports"})) for k in range(9001, 12001)]
    store = Incremental(spark, f"{tmp_path}/store", buckets=128, target=10**6)
    store.apply(spark.createDataFrame(log, SCHEMA))
    more = [(20001, "r5", "CLAIM_OBSERVED", '{"claimId":"c77","familyId":"f","subject":"s","observedAt":"u"}'), (20002, "r6", "EVIDENCE_LINKED", '{"id":"e9078","claimId":"c99","stance":"opposes"}'), (20003, "r7", "CLAIM_MERGED", '{"claimId":"c3","intoClaimId":"c4"}'), (20004, "x", "RUN_ROLLED_BACK", '{"run_id":"r8"}')]
    report = store.apply(spark.createDataFrame(more, SCHEMA))
    same(store, spark.createDataFrame(log + more, SCHEMA))
    whole = {name: t.rows() for name, t in store.tables.items()}
    assert sum(report["read"].values()) < 0.2 * sum(whole.values()) and report["read"]["facts"] < 0.1 * whole["facts"] and report["read"]["claims"] < 0.15 * whole["claims"]
    assert report["written"]["facts"] == 3


def test_a_batch_that_is_run_again_replaces_what_it_wrote(spark, tmp_path):
    events = made(200, 2)
    Incremental(spark, f"{tmp_path}/s", 0, buckets=2).apply(spark.createDataFrame(events[:120], SCHEMA), 0)
    for _ in range(2):
        Incremental(spark, f"{tmp_path}/s", 1, buckets=2).apply(spark.createDataFrame(events[120:], SCHEMA), 1)
    same(Incremental(spark, f"{tmp_path}/s"), spark.createDataFrame(events, SCHEMA))


def test_replay_from_a_checkpoint_with_a_rollback_across_it(spark, tmp_path):
    events = [e for e in made(240, 3) if e[2] != "RUN_ROLLED_BACK"]
    events[200] = (events[200][0], "x", "RUN_ROLLED_BACK", '{"run_id":"r3"}')
    log = spark.createDataFrame(events, SCHEMA)
    folder = f"{tmp_path}/s"
    store, sound = incremental.resumed(spark, folder, spark.createDataFrame(events[:150], SCHEMA), buckets=2)
    assert not sound and store.cursor == events[149][0]
    store, sound = incremental.resumed(spark, folder, log, buckets=2)
    assert sound and store.reports[0]["written"]["facts"] < 90
    same(store, log)
    files.write_text(spark, f"{folder}/manifest-{store.batch}.json", "{broken")
    store, sound = incremental.resumed(spark, folder, log, buckets=2)
    assert not sound and store.batch == 0
    same(store, log)
    version = next(iter(store.tables["known"].entries.values()))[0][0]
    files.remove(spark, f"{folder}/known/v{version}")
    store, sound = incremental.resumed(spark, folder, log, buckets=2)
    assert not sound
    same(store, log)


def test_a_stream_of_batches_nothing_at_all_and_growing_buckets(spark, tmp_path):
    events = made(300, 4)
    for k in range(3):
        spark.createDataFrame(events[100 * k : 100 * k + 100], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    query = incremental.maintained(stream, f"{tmp_path}/store", f"{tmp_path}/cp", buckets=1, target=40)
    query.awaitTermination()
    store = Incremental(spark, f"{tmp_path}/store")
    assert query.exception() is None and store.batch == 2 and store.tables["facts"].count > 1
    same(store, spark.createDataFrame(events, SCHEMA))
    empty = Incremental(spark, f"{tmp_path}/none")
    empty.apply(spark.createDataFrame([], SCHEMA))
    assert all(v.isEmpty() for v in empty.views().values()) and empty.cursor is None
    assert [tuple(store.status(n).first()) for n in (None, 300, 301)] == [(1, 300, "ready"), (1, 300, "ready"), (1, 300, "behind")]
    assert Incremental(spark, f"{tmp_path}/nowhere").status().first().status == "empty"
    odd = [(1, None, "CLAIM_OBSERVED", "{}"), (2, None, "CLAIM_MERGED", '{"claimId":"a","intoClaimId":"a"}'), (3, None, "CLAIM_OBSERVED", '{"claimId":"a"}'), (4, "r", "WHAT", None)]
    empty.apply(spark.createDataFrame(odd, SCHEMA))
    assert [(r.id, r.n_observations, r.family_id) for r in empty.views()["claims"].collect()] == [("a", 1, None)]


@pytest.mark.parametrize("column", ["n", "last_seq"])
def test_merging_facts_is_associative(spark, column):
    facts = incremental.lifted(spark.createDataFrame(made(150, 5), SCHEMA)).select("kind", "key", *incremental.NAMES).cache()
    parts = [facts.where(F.pmod(F.xxhash64("key", "n", "last_seq", "first_seq"), F.lit(3)) == k) for k in range(3)]
    left = incremental.merged(incremental.merged(parts[0].union(parts[1])).union(parts[2]))
    right = incremental.merged(parts[0].union(incremental.merged(parts[1].union(parts[2]))))
    want = sorted(map(str, incremental.merged(facts).collect()))
    assert column in left.columns and sorted(map(str, left.collect())) == sorted(map(str, right.collect())) == want


def test_a_large_first_batch_is_written_once(spark, tmp_path):
    log = spark.createDataFrame(made(300, 8), SCHEMA)
    store = Incremental(spark, f"{tmp_path}/store", buckets=1, target=10)
    report = store.apply(log)
    facts = store.tables["facts"]
    assert report["written"]["facts"] == facts.rows() == incremental.lifted(log).count() and facts.rows() <= 10 * facts.count
    same(store, log)
