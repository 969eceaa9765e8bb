"""Operators that SQL cannot say, against brute force; files, archives, streams and the facade."""

import collections
import itertools
import json
import random

import pytest

from mossgraph.api import Knowledge
from mossgraph.functions.text import anchor_terms, anchors, discriminators
from mossgraph import retry
from mossgraph.operators import cluster, feeds, knowledge, ledger, reconcile, research, resolve, rollback, workingset
from mossgraph.sources import archive, files, mappers
from mossgraph.sources.events import EventLog, StaleLog
from mossgraph.streaming import feeds as live


def greedy(edges, most):
    held, out = collections.Counter(), []
    for a, b in sorted(edges):
        if held[a] < most and held[b] < most:
            out.append((a, b))
            held[a] += 1
            held[b] += 1
    return out


@pytest.mark.parametrize(("seed", "folded"), [(1, 0), (2, 0), (2, 1_000_000), (1, 40)])
def test_capped_edges_are_taken_greedily(spark, monkeypatch, seed, folded):
    monkeypatch.setattr(cluster, "FOLD", folded)
    random.seed(seed)
    edges = sorted({(random.randint(1, 12), random.randint(13, 30)) for _ in range(150)} | {(1, k) for k in range(2, 31)})
    got = cluster.capped_edges(spark.createDataFrame(edges, "a long, b long"), 3)
    assert sorted(map(tuple, got.collect())) == greedy(edges, 3)
    assert cluster.capped_edges(spark.createDataFrame([], "a long, b long")).count() == 0


def test_claim_clusters(spark):
    random.seed(7)
    words = "alpha beta gamma delta epsilon removed adds v1.2 v2.0 2024 REST Red Blue".split()
    rows = [(k, " ".join(random.choices(words, k=3)), " ".join(random.choices(words, k=2)), random.choice([None, "", " ".join(random.choices(words, k=2))])) for k in range(60)]
    claims = spark.createDataFrame(rows, "id long, subject string, predicate string, object string")
    got = {(r.a, r.b): r for r in cluster.claim_edges(claims).collect()}
    lines = cluster.rendered(claims.subject, claims.predicate, claims.object, "lines")
    sets = {r.id: r for r in claims.select("id", lines.alias("text"), anchor_terms(lines).alias("t"), anchors(lines).alias("a"), discriminators(lines).alias("d")).collect()}
    import re

    plain = {k: re.sub("[^a-z0-9@._/-]+", " ", r.text.lower()).strip() for k, r in sets.items()}
    want = {}
    for x, y in itertools.combinations(sorted(sets), 2):
        t, u, a, b = set(sets[x].t), set(sets[y].t), set(sets[x].a), set(sets[y].a)
        lexical = round(len(t & u) / len(t | u), 6) if t and u else 0
        anchor = len(a & b) / min(len(a), len(b)) if a and b else 0
        if plain[x] == plain[y]:
            want[x, y] = ("direct", 1.0)
        elif anchor >= 0.92 and lexical >= 0.25:
            want[x, y] = ("direct", (anchor + lexical) / 2)
        elif lexical >= 0.58:
            want[x, y] = ("lexical", lexical)
    assert {k: (r.method, pytest.approx(r.score, abs=1e-5)) for k, r in got.items()} == want
    assert sorted((r.a, r.b) for r in cluster.claim_clusters(claims, most=3).collect()) == greedy(want, 3)


def test_edges_between_clusters(spark):
    random.seed(3)
    words = [f"w{k}" for k in range(14)]
    rows = [(k, random.sample(words, 6), k % 3 > 0, 1) for k in range(80)]
    frame = spark.createDataFrame(rows, "id long, tokens array<string>, positive boolean, block int")
    clusters = spark.createDataFrame([(k, k - k % 2) for k in range(80)], "id long, cluster long")
    first = {}
    for (i, t, p, _), (j, u, q, _) in itertools.combinations(rows, 2):
        score = round(len(set(t) & set(u)) / len(set(t) | set(u)), 6)
        x, y = sorted((i - i % 2, j - j % 2))
        if x != y and score >= 0.58:
            first.setdefault((x, y), (i, j, "contradicts" if p != q else "same_claim" if score >= 0.92 else "supports", "strong" if score >= 0.75 else "weak"))
    held, want = collections.Counter(), []
    for (x, y), (_, _, relation, strength) in sorted(first.items(), key=lambda e: e[1][:2]):
        if held[x] < 8 and held[y] < 8:
            want.append((x, y, relation, strength))
            held[x] += 1
            held[y] += 1
    got = cluster.cluster_edges(frame, clusters, ["block"])
    assert sorted(tuple(r) for r in got.select("a", "b", "relation", "strength").collect()) == sorted(want) and want


def test_aliases_follow_chains_and_end_in_cycles(spark):
    moves = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s"), *[(f"n{k:03}", f"n{k + 1:03}") for k in range(70)]]
    got = dict(map(tuple, knowledge.aliases(spark.createDataFrame(moves, "id string, to string")).collect()))
    assert got == {"a": "d", "b": "d", "c": "d", "y": "x", "z": "x", **{f"n{k:03}": "n070" for k in range(70)}}
    assert knowledge.aliases(spark.createDataFrame([], "id string, to string")).count() == 0


def test_numbered_and_throttled(spark):
    rows = [(random.random(), k) for k in range(500)]
    got = workingset.numbered(spark.createDataFrame(rows, "x double, k long").repartition(7), "x", "k").orderBy("n").collect()
    assert [(r.x, r.k, r.n) for r in got] == [(x, k, n + 1) for n, (x, k) in enumerate(sorted(rows))]
    random.seed(5)
    progress = [(run, s, float(s * random.randint(1, 4)), "p" if s < 20 else "q") for run in range(4) for s in range(40)]
    progress = [(r, s, max(a for q, t, a, _ in progress if q == r and t <= s), p) for r, s, a, p in progress]
    want = []
    for run in range(4):
        last = phase = None
        mine = [x for x in progress if x[0] == run]
        for k, (_, s, at, p) in enumerate(mine):
            if last is None or p != phase or at - last >= 25:
                want.append((run, s))
                last, phase = at, p
            elif k + 1 == len(mine):
                want.append((run, s))
    frame = spark.createDataFrame(progress, "run_id long, seq long, at double, phase string")
    assert sorted(map(tuple, feeds.throttled(frame, 25.0).collect())) == sorted(want)


def test_breaker_opens_cools_and_begins_anew(spark):
    random.seed(9)
    rows = [(key, s, float(10 * s), random.random() < (0.95 if s % 60 < 30 else 0.2)) for key in range(3) for s in range(150)]
    want = []
    for key in range(3):
        window, opened = [], None
        for _, s, at, failed in (r for r in rows if r[0] == key):
            if opened is not None and at - opened < 60:
                want.append((key, s, True, True))
                continue
            window, opened = ([] if opened is not None else window), None
            window = (window + [failed])[-10:]
            if len(window) >= 5 and sum(window) / len(window) > 0.8:
                opened = at
            want.append((key, s, False, opened is not None))
    got = ledger.breaker_states(spark.createDataFrame(rows, "key long, seq long, at double, failed boolean"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(w[2] for w in want)


def test_retries():
    waits, tried = [], []

    def call(fail):
        tried.append(1)
        if len(tried) <= fail:
            raise OSError("for a while")
        return len(tried)

    assert retry.retried(lambda: call(2), lambda e: isinstance(e, OSError), sleep=waits.append, chance=lambda: 1.0) == 3 and waits == [1.0, 2.0]
    tried.clear()
    with pytest.raises(OSError):
        retry.retried(lambda: call(9), lambda e: True, attempts=2, sleep=waits.append)
    with pytest.raises(OSError):
        retry.retried(lambda: call(9), lambda e: False, sleep=waits.append)
    with pytest.raises(retry.Aborted):
        retry.retried(lambda: 1, lambda e: True, aborted=lambda: True)


def test_judged_entity_merges(spark):
    rows = [(k, "product", t, t.split()) for k, t in enumerate(["red box", "red box two", "red cup", "blue cup"])]
    frame = spark.createDataFrame(rows, "id long, kind string, label string, tokens array<string>")
    assert resolve.entity_merges(frame).count() == 0
    assert [(r.a, r.b) for r in resolve.entity_merges(frame, thresholds={"product": 0.6}).collect()] == [(0, 1)]
    assert sorted((r.a, r.b) for r in resolve.entity_merges(frame, judge=lambda pairs: pairs.where("b = 2")).collect()) == [(0, 2)]


def test_passages(spark):
    random.seed(2)
    text = "".join(random.choice(["word ", "more ", "\n", "\n\n", "# Head\n"]) for _ in range(900))
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, ""), (4, None), (5, "x" * 9000)], "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in research.segmented(docs, size=500).orderBy("id", "n").collect():
        got[r.id].append(r)
    assert set(got) == {1, 2, 5}
    for r in got.values():
        assert "".join(x.passage for x in r) == {1: text, 2: "short", 5: "x" * 9000}[r[0].id]
        assert all(x.end - x.start <= 500 for x in r) and [x.n for x in r] == list(range(len(r)))
    assert all(x.passage.endswith("\n") for x in got[1][:-1])
    chosen = collections.defaultdict(list)
    passages = research.segmented(docs, size=500)
    for r in research.selected(passages, "word more").collect():
        chosen[r.id].append(r.n)
    assert sorted(chosen[2]) == [0] and len(chosen[1]) == 6 and len(chosen[5]) == 6
    sizes = {(r.id, r.n): len(r.passage) for r in passages.collect()}
    assert all(sum(sizes[k, n] for n in c) <= research.BUDGET for k, c in chosen.items())


def test_cases_by_change(spark):
    base = {"family_id": "f", "subject": "alpha beta", "predicate": "is", "object": "gamma", "polarity": "positive", "hedge": "likely", "value": None, "unit": None, "event_date": None, "version": None, "entity_id": None}
    made = {
        1: ({}, "same_claim"), 2: ({"polarity": "negative"}, "contradiction"), 3: ({"subject": "quite another", "object": "thing"}, "new_claim"), 4: ({"object": "gamma ray"}, "elaboration"), 5: ({"polarity": "conditional"}, "qualification"),
        6: ({"version": "2.0", "object": "replaces gamma"}, "supersedes"),
    }
    schema = "id long, family_id string, subject string, predicate string, object string, polarity string, hedge string, value double, unit string, event_date string, version string, entity_id string"
    names = [x.split()[0] for x in schema.split(", ")]
    row = lambda k, change: tuple({**base, "id": k, "family_id": str(k), **change}[n] for n in names)
    observed = spark.createDataFrame([row(k, c) for k, (c, _) in made.items()], schema)
    claims = spark.createDataFrame([row(k, {"version": "1.0"} if k == 6 else {}) for k in made], schema)
    from mossgraph.operators import evaluate

    got = {r.id: r for r in evaluate.cases(observed, claims, reconcile.plan_batch).collect()}
    assert {k: r.classification for k, r in got.items()} == {k: c for k, (_, c) in made.items()}
    assert all((r.matched is None) == (r.classification == "new_claim") for r in got.values())


def _events(spark, n=30):
    rows = [(k, "2024-01-01", "NODE_ADDED", f"r{k % 3}", "agent", f"n{k % 7}", json.dumps({"id": f"n{k % 7}", "label": f"L{k}"})) for k in range(n)]
    return spark.createDataFrame(rows, "ord long, timestamp string, event_type string, run_id string, actor string, entity_id string, payload string")


def test_canonical_json():
    from mossgraph.sources.events import canonical

    assert canonical({"b": [2, 1.0, {"d": None, "c": "é"}], "a": True}) == '{"a":true,"b":[2,1,{"c":"é","d":null}]}'
    assert canonical({"x": 1, "y": {"p": 0, "q": 1}}) == canonical({"y": {"q": 1.0, "p": 0}, "x": 1}) != canonical({"x": 1, "y": {"p": 1, "q": 0}})
    assert canonical([1, 2]) != canonical([2, 1])
    for bad in (float("nan"), float("inf"), {"x": {1, 2}}, object()):
        with pytest.raises((ValueError, TypeError)):
            canonical(bad)


def test_golden_views_and_digests_of_files(spark, tmp_path):
    import hashlib

    from mossgraph.operators import evaluate

    rows = lambda *r: spark.createDataFrame(list(r), "id long, v string")
    views = {"claims": rows((1, "a"), (2, "b"), (3, None)), "gaps": rows((9, "g"))}
    folder, of = f"{tmp_path}/golden", {"reconciler": "3"}
    evaluate.build_golden(views, folder, of)
    assert evaluate.compare_golden(views, folder, of).count() == 0
    changed = {"claims": rows((1, "a"), (2, "c"), (4, "d")), "gaps": rows((9, "g"))}
    assert sorted(map(tuple, evaluate.compare_golden(changed, folder, of).collect())) == [("claims", 2, "changed"), ("claims", 3, "missing"), ("claims", 4, "unexpected")]
    for wrong, why in (((views, folder, {"reconciler": "4"}), "not"), (({"claims": views["claims"]}, folder, of), "collections"), ((views, f"{tmp_path}/none", of), "no manifest")):
        with pytest.raises(evaluate.BadGolden, match=why):
            evaluate.compare_golden(*wrong)
    with pytest.raises(FileExistsError):
        evaluate.build_golden(views, folder, of)
    rows((9, "other")).write.mode("overwrite").parquet(f"{folder}/gaps")
    with pytest.raises(evaluate.BadGolden, match="gaps"):
        evaluate.compare_golden(views, folder, of)
    (tmp_path / "files" / "in").mkdir(parents=True)
    (tmp_path / "files" / "a").write_bytes(b"x" * 1000)
    (tmp_path / "files" / "in" / "b").write_bytes(b"")
    (tmp_path / "files" / "in" / "c").write_bytes(b"c")
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in files.digests(spark, f"{tmp_path}/files").collect()}
    assert got == {"a": (1000, hashlib.sha256(b"x" * 1000).hexdigest()), "c": (1, hashlib.sha256(b"c").hexdigest())}


def test_append_asks_codecs_and_references(spark, tmp_path):
    from mossgraph.operators import validation
    from mossgraph.sources.events import InvalidEvent

    event = lambda k, kind, version=1, **body: (k, "t", kind, "r", "agent", None, json.dumps(body), version)
    frame = lambda rows: spark.createDataFrame(rows, "ord long, timestamp string, event_type string, run_id string, actor string, entity_id string, payload string, event_version int")
    codecs = validation.example_codecs() | {"NODE_ADDED": validation.Codec({1: {"id": "STRING"}}, {})}
    named = {"targetId": "n1", "oldLabel": "a", "newLabel": "b"}
    log = EventLog(spark, f"{tmp_path}/log")
    for bad, why in (([event(1, "WHAT")], "EVENT_TYPE_UNKNOWN"), ([event(1, "NODE_ADDED", 3, id="n1")], "EVENT_VERSION_UNSUPPORTED"), ([event(1, "NODE_ADDED", id=7)], "EVENT_PAYLOAD_INVALID"), ([event(1, "NODE_RELABELED", **named), event(2, "NODE_ADDED", id="n1")], "EVENT_REFERENCE_INVALID")):
        with pytest.raises(InvalidEvent, match=why):
            log.append(frame(bad), 0, codecs, ("entity",))
    assert log.latest() == 0
    assert log.append(frame([event(1, "NODE_ADDED", id="n1"), event(2, "NODE_RELABELED", **named)]), 0, codecs, ("entity",)) == 2
    assert log.append(frame([event(1, "NODE_RELABELED", 2, weight=3, **named)]), 2, codecs, ("entity",)) == 3
    with pytest.raises(InvalidEvent):
        log.append(frame([event(1, "NODE_RELABELED", **(named | {"targetId": "n2"}))]), 3, codecs, ("entity",))
    checks = lambda cursor, status="ready": {r.name: r.status for r in validation.doctor(log.scan(), cursor, status).collect()}
    fine = {"event_log": "ok", "places": "ok", "payloads": "ok", "read_model": "ok", "overall": "ok"}
    assert checks(3) == fine and checks(1) == fine | {"read_model": "warning", "overall": "warning"} and checks(3, "dirty") == fine | {"read_model": "error", "overall": "error"}
    assert {r.status for r in validation.doctor(log.scan().limit(0), None).collect()} == {"warning", "ok"}


def test_append_numbers_and_refuses_stale_writers(spark, tmp_path):
    log = EventLog(spark, f"{tmp_path}/log")
    assert log.append(_events(spark).repartition(5), 0) == 30
    assert [(r.seq, json.loads(r.payload)["label"]) for r in log.scan().collect()] == [(k + 1, f"L{k}") for k in range(30)]
    with pytest.raises(StaleLog):
        log.append(_events(spark, 3), 0)
    assert files.create_once(spark, f"{log.path}_claims/30")  # another writer is at work
    with pytest.raises(StaleLog):
        log.append(_events(spark, 3), 30)
    files.remove(spark, f"{log.path}_claims/30")
    assert log.append(_events(spark, 3), 30) == 33 and log.corrupt().count() == 0


def test_export_backup_restore_and_snapshots(spark, tmp_path):
    log = EventLog(spark, f"{tmp_path}/log")
    log.append(_events(spark), 0)
    rebuild = lambda rows: {"entities": knowledge.entities(rows)}
    rows = log.scan()
    manifest = archive.backup(rows, rebuild(rows), f"{tmp_path}/backup", {"projection": 1})
    assert manifest["count"] == manifest["latestSeq"] == 30
    with pytest.raises(FileExistsError):
        archive.export(rows, f"{tmp_path}/backup")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    views = archive.restore(spark, f"{tmp_path}/backup", schema, rebuild, f"{tmp_path}/restored")
    assert sorted(map(str, views["entities"].collect())) == sorted(map(str, rebuild(rows)["entities"].collect()))
    files.write_text(spark, f"{tmp_path}/backup/manifest.json", json.dumps(manifest | {"count": 29}))
    with pytest.raises(archive.BadBackup):
        archive.restore(spark, f"{tmp_path}/backup", schema, rebuild, f"{tmp_path}/again")

    folder = f"{tmp_path}/snapshots"
    for cursor in (10, 20, 25, 30):
        archive.take_snapshot(rebuild(rows.where(f"seq <= {cursor}")), folder, cursor, 1, keep=3)
    archive.take_snapshot(rebuild(rows), folder, 30, 1)
    assert [e["cursor"] for e in archive.snapshots(spark, folder)] == [20, 25, 30] and not files.exists(spark, f"{folder}/10-1")
    assert archive.latest_snapshot(spark, folder, 1, 28)["cursor"] == 25 and archive.latest_snapshot(spark, folder, 2) is None
    archive.invalidate(spark, folder)
    assert archive.latest_snapshot(spark, folder, 1) is None


def test_rollback_batch_undoes_a_run(spark):
    rows = [
        (1, "r0", "NODE_ADDED", "n1", {"id": "n1", "label": "old"}), (2, "r1", "NODE_RELABELED", "n1", {"targetId": "n1", "oldLabel": "old", "newLabel": "new"}), (3, "r2", "NODE_ADDED", "n2", {"id": "n2"}),
        (4, "r2", "GAP_RESOLVED", "g1", {"gapId": "g1", "previousStatus": "open", "newStatus": "resolved"}), (5, "r3", "GAP_OPENED", "g1", {"id": "g1"}), (6, "r4", "CLAIM_MERGED", "c1", {"sourceClaimId": "c1", "survivorClaimId": "c2"}),
    ]
    log = spark.createDataFrame([(*r[:4], json.dumps(r[4])) for r in rows], "seq long, run_id string, event_type string, entity_id string, payload string")
    assert {r.run_id: r.outcome for r in rollback.rollback_outcomes(log).collect()} == {"r0": "executed", "r1": "executed", "r2": "blocked", "r3": "executed", "r4": "refused"}
    batch = rollback.rollback_batch(log, "r1", "now").orderBy("ord").collect()
    assert [(r.event_type, json.loads(r.payload)) for r in batch] == [("RUN_ROLLED_BACK", {"run_id": "r1"}), ("NODE_RELABELED", {"targetId": "n1", "oldLabel": "new", "newLabel": "old"})]
    for run in ("r2", "r4"):
        with pytest.raises(ValueError):
            rollback.rollback_batch(log, run, "now")
    assert rollback.rollback_batch(log, "none", "now") is None


def test_views_follow_a_stream(spark, tmp_path):
    log = _events(spark).withColumnRenamed("ord", "seq")
    log = log.select("seq", "run_id", "event_type", "entity_id", "timestamp", "payload")
    rebuild = lambda rows: {"entities": knowledge.entities(rows)}
    for part in (0, 1):
        log.where(f"seq % 2 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = live.maintained(stream, lambda: spark.read.parquet(f"{tmp_path}/in"), rebuild, f"{tmp_path}/views", f"{tmp_path}/checkpoint")
    query.awaitTermination()
    assert query.exception() is None
    got = live.latest(spark, f"{tmp_path}/views", "entities")
    assert sorted(map(str, got.collect())) == sorted(map(str, knowledge.entities(log).collect()))


def test_recorded_responses_as_a_source(spark, tmp_path):
    for method, name, body in (("search", "a", '{"results":[]}'), ("search", "b", "[]"), ("read", "c", '{"content":"x"}')):
        (tmp_path / method).mkdir(exist_ok=True)
        (tmp_path / method / f"{name}.json").write_text(body)
    spark.dataSource.register(mappers.FixtureProvider)
    rows = spark.read.format("fixture_provider").option("path", str(tmp_path)).load()
    assert sorted(map(tuple, rows.collect())) == [("read", "c", '{"content":"x"}'), ("search", "a", '{"results":[]}'), ("search", "b", "[]")]


def test_actions_can_be_registered(spark):
    views = {"gaps": spark.createDataFrame([("g1", "f1"), ("g2", "f2")], "id string, family_id string")}
    facade = Knowledge(views, spark.createDataFrame([], "seq long, event_type string, payload string"))
    assert [r.id for r in facade.ask("gaps", family_id="f2").collect()] == ["g2"]
    facade.register("urgent", lambda: views["gaps"].limit(1))
    assert facade.ask("urgent").count() == 1
    with pytest.raises(KeyError):
        facade.ask("nothing")
