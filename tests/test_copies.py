"""Operators on pairs over tables of many copies: what is shuffled and written grows with the copies, not with their pairs."""

import itertools

import pytest

from mossgraph.operators import cluster, graph, reconcile, research, resolve

N = 600


def made(frame):
    """The rows of a frame and the most rows that any shuffle of it was given."""
    rows = frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    found, todo = [0], [plan]
    while todo:
        node = todo.pop()
        inner = [node.executedPlan()] if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else [node.plan()] if node.getClass().getSimpleName().endswith("QueryStageExec") else []
        children = node.children()
        todo += inner + [children.apply(k) for k in range(children.size())]
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
    return rows, max(found)


def test_similar_pairs_of_copies(spark):
    words = [["a", "b", "c", "d", "e"], ["b", "a", "c", "d", "f"], ["x", "y"]]
    frame = spark.createDataFrame([(k, "z", words[k % 3]) for k in range(N)], "id long, block string, tokens array<string>")
    rows, shuffled = made(graph.similar_pairs(frame, 0.6, ["block"]))
    want = {(a, b): 1.0 if a % 3 == b % 3 else 0.666667 for a, b in itertools.combinations(range(N), 2) if a % 3 == b % 3 or 2 not in (a % 3, b % 3)}
    assert {(r.a, r.b): r.score for r in rows} == want and len(rows) == len(want)
    assert shuffled < 10 * N


def test_pairs_between_different_sets_are_all_found(spark):
    import random

    seed = random.Random(5)
    sets = [(k, "z", seed.sample("abcdefghijklmn", seed.randint(1, 9))) for k in range(250)]
    frame = spark.createDataFrame(sets, "id long, block string, tokens array<string>")
    for least in (0.3, 0.58, 0.92):
        share = lambda x, y: round(len({*x} & {*y}) / len({*x} | {*y}), 6)
        want = {(a, b, share(x, y)) for (a, _, x), (b, _, y) in itertools.combinations(sets, 2) if share(x, y) >= least}
        assert {tuple(r) for r in graph.similar_pairs(frame, least, ["block"]).collect()} == want


def test_related_of_copies(spark):
    data = [(k, f"q{k % 4}" if k % 5 else None, ["a", "b", "c"] if k % 2 else ["a", "x", "y"]) for k in range(N)]
    frame = spark.createDataFrame(data, "id long, question string, tokens array<string>")
    rows, shuffled = made(graph.related(frame.where("id % 50 = 0"), frame, 0.35))
    want = set()
    for a, qa, ta in data[::50]:
        for b, qb, tb in data[a + 1:]:
            shared = qa is not None and qa == qb
            if shared or ta == tb:
                want.add((a, b, shared))
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    assert shuffled < 2 * N


@pytest.mark.parametrize("n", [1, 3])
def test_best_of_copies(spark, n):
    """Of a single weak target there is a match, of its copies none is clear; a confident one answers by its smallest id."""
    queries = spark.createDataFrame([(k, ["a", "b", "c", "d"] if k % 2 else ["k", "l"]) for k in range(40)], "id long, tokens array<string>")
    known = spark.createDataFrame([(100 + k, ["a", "b", "p", "q"]) for k in range(n)] + [(200 + k, ["l", "k"]) for k in range(n)], "target_id long, tokens array<string>")
    rows = resolve.resolve_entities(queries, known).collect()
    assert len(rows) == 40
    for r in rows:
        assert r.created == (r.id % 2 == 1 and n > 1)
        assert r.created or r.entity_id == ("100" if r.id % 2 else "200")


def test_contradictions_of_copies(spark):
    said = ["it may grow and shrink", "it may grow", "it may not grow"]
    data = [(k, [k % 2, 7 + k % 3], said[k // 2 % 3]) for k in range(N)]
    frame = spark.createDataFrame(data, "id long, questions array<long>, text string")
    rows, shuffled = made(resolve.contradictions(frame))
    want = set()
    for (a, qa, ta), (b, qb, tb) in itertools.combinations(data, 2):
        x, y = {*ta.split()}, {*tb.split()}
        score = round(len(x & y) / len(x | y), 6)
        if {*qa} & {*qb}:
            if score > 0.3 and ("not" in x) != ("not" in y):
                want.add((a, b, "negation"))
        elif score > 0.35 and (("grow" in ta and "shrink" in tb) or ("shrink" in ta and "grow" in tb)):
            want.add((a, b, "direction"))
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    assert shuffled < 10 * N


def test_claim_edges_of_copies(spark):
    data = [(k, "red bolt", "LARGE", f"Brand#{k % 2}") for k in range(N)]
    rows, shuffled = made(cluster.claim_edges(spark.createDataFrame(data, "id long, subject string, predicate string, object string")))
    assert len({(r.a, r.b) for r in rows}) == len(rows) == N * (N - 1) // 2
    assert all((r.method == "direct") == ((r.a - r.b) % 2 == 0) for r in rows)
    assert shuffled < 10 * N


def test_entity_merges_and_cluster_edges_of_copies(spark):
    data = [(k, "product", "Red bolt", ["red", "bolt"]) for k in range(60)]
    entities = spark.createDataFrame(data, "id long, kind string, label string, tokens array<string>")
    aliases = spark.createDataFrame([(3, "red BOLT")], "id long, alias string")
    merges = resolve.entity_merges(entities, aliases).collect()
    assert len({(r.a, r.b) for r in merges}) == len(merges) == 60 * 59 // 2 and {(r.score, r.method) for r in merges} == {(1.0, "exact")}
    findings = spark.createDataFrame([(k, "z", ["a", "b", "c"] if k % 3 else ["a", "b", "c", "d"], k % 2 == 0) for k in range(60)], "id long, block string, tokens array<string>, positive boolean")
    clusters = graph.linked_findings(findings, ["block"])
    first = {r.id: r.cluster for r in clusters.collect()}
    assert first == {k: next(j for j in range(60) if (j % 2, j % 3 == 0) == (k % 2, k % 3 == 0)) for k in range(60)}
    edges = {(r.a, r.b, r.relation, r.score) for r in cluster.cluster_edges(findings, clusters, ["block"]).collect()}
    assert edges == {(0, 1, "contradicts", 0.75), (0, 2, "supports", 0.75), (0, 3, "contradicts", 1.0), (1, 2, "contradicts", 1.0), (1, 3, "supports", 0.75), (2, 3, "contradicts", 0.75)}


def test_capped_edges_of_copies_make_no_pairs(spark, monkeypatch):
    """The greedy cap over classes of copies is that over all their pairs, which are not made."""
    import random

    seed = random.Random(3)
    words = ["red bolt", "blue bolt", "red ring", "tin plate v1.2", "tin plate v2.0", "old cog"]
    data = [(k, seed.choice(words), "LARGE", f"Brand#{seed.randint(1, 2)}") for k in seed.sample(range(9 * N), N)]
    claims = spark.createDataFrame(data, "id long, subject string, predicate string, object string")
    edges = [(r.a, r.b, r.score) for r in cluster.claim_edges(claims).orderBy("a", "b").collect()]
    held, want = dict.fromkeys((k for k, *_ in data), 0), []
    for a, b, score in edges:
        if held[a] < 8 and held[b] < 8:
            want.append((a, b, score))
            held[a], held[b] = held[a] + 1, held[b] + 1
    monkeypatch.setattr(cluster, "expanded", None)
    rows, shuffled = made(cluster.claim_clusters(claims))
    assert sorted((r.a, r.b, r.score) for r in rows) == want and len(want) < len(edges) / 10
    assert shuffled < 10 * N


def test_batch_and_pair_scores_of_copies(spark):
    """Copies are scored once; an observation that comes from the claims does not meet itself, but its copies."""
    data = [(k, f"f{k % 2}", f"red bolt {k % 4}", "is", None if k % 3 else "large", "positive", "certain", float(k % 4), "kg") for k in range(N)] + [(N, "f9", "alone", "is", None, "positive", "certain", 1.0, "kg")]
    frame = spark.createDataFrame(data, "id long, family_id string, subject string, predicate string, object string, polarity string, hedge string, value double, unit string")
    frame = frame.selectExpr("*", "cast(null as string) event_date", "cast(null as string) version", "cast(null as string) entity_id")
    queries = frame.where("id % 50 = 0")
    rows, shuffled = made(reconcile.scored_pairs(queries, frame, itself=False))
    got = {(r.o_id, r.c_id): r.score for r in rows}
    assert len(got) == len(rows) and got.keys() == {(a, b) for a in range(0, N, 50) for b in range(N) if a != b and a % 2 == b % 2}
    assert all(s == 1.0 for (a, b), s in got.items() if a % 4 == b % 4 and (a % 3 == 0) == (b % 3 == 0))
    assert shuffled < 2 * N
    rows, shuffled = made(reconcile.plan_batch(queries, frame, itself=False))
    assert shuffled < 2 * N and len(rows) == 13
    for r in rows:
        alike = next((k for k in range(N) if k != r.observation_id and k % 4 == r.observation_id % 4 and (k % 3 == 0) == (r.observation_id % 3 == 0)), None) if r.observation_id < N else None
        assert (r.matched_claim_id, r.classification) == ((alike, "same_claim") if alike is not None else (None, "new_claim"))
        assert r.score == (1.0 if alike is not None else 0.0)


def test_rows_are_gathered_before_they_are_grouped(spark, monkeypatch):
    """Tasks that group hold a bounded number of rows, and none sums up rows of all keys before the shuffle."""
    monkeypatch.setattr(graph, "GROUPED", 50)
    links = spark.range(N).selectExpr("id % 40 as question", "id as source_id", "concat('d', id % 3) as domain", "0.5D as confidence", "false as failed")
    assert graph.gathered(links, N, "question").rdd.getNumPartitions() == N // 50
    found = research.question_coverage(spark.range(41).withColumnRenamed("id", "question"), links, N)
    rows, shuffled = made(found)
    assert {(r.question, r.n_sources, r.n_domains, r.n_findings, r.status) for r in rows} == {(k, 15, 3, 15, "adequate") for k in range(40)} | {(40, 0, 0, 0, "uncovered")}
    assert shuffled <= N


def test_passages_are_handed_on_in_bounded_pieces(spark):
    docs = spark.range(30).selectExpr("id as doc_id", "repeat(concat('line ', id, '\n'), cast(id * 20 as int)) as text")
    got = {(r.id, r.n): r for r in research.segmented(docs, size=200, most=500).collect()}
    for r in docs.collect():
        want = research.windows_of(r.text, 200)
        assert [(got[r.doc_id, n].start, got[r.doc_id, n].end, got[r.doc_id, n].passage) for n in range(len(want))] == [(a, b, r.text[a:b]) for a, b in want]
    assert len(got) == sum(len(research.windows_of(r.text, 200)) for r in docs.collect())


def test_long_sets_that_are_unlike_are_told_apart_before_they_are_shuffled(spark):
    """Sets of 250 words of which a fifth are common: a signature of 256 bits could not tell them from like ones."""
    import random

    seed = random.Random(3)
    sets = [(k, "z", [f"w{w}" for w in seed.sample(range(1250), 250)]) for k in range(120)]
    sets += [(1000 + k, "z", words[:-20]) for k, _, words in sets[:5]]
    pairs = graph.similar_pairs(spark.createDataFrame(sets, "id long, block string, tokens array<string>"), 0.58, ["block"])
    assert {(r.a, r.b, r.score) for r in pairs.collect()} == {(k, 1000 + k, 0.92) for k in range(5)}
    plan, met = pairs._jdf.queryExecution().executedPlan(), set()
    todo = [plan]
    while todo:
        node = todo.pop()
        name, children, output = node.getClass().getSimpleName(), node.children(), node.output()
        todo += [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
        todo += [children.apply(k) for k in range(children.size())]
        if name == "ShuffleExchangeExec" and [output.apply(k).name() for k in range(output.size())] == ["a", "b"]:
            met.add(node.metrics().apply("shuffleRecordsWritten").value())
    assert met and max(met) < 1000  # the pairs by each of their rare common words, and few others


def test_pairs_are_shuffled_without_their_members(spark):
    """Each finding has questions of its own, so each pair of findings is decided by itself; pairs of texts are what travels."""
    said = ["it may grow", "it may not grow"]
    data = [(k, [k, 10_000 + k // 2 % 7], said[k % 2]) for k in range(N)]
    rows, shuffled = made(resolve.contradictions(spark.createDataFrame(data, "id long, questions array<long>, text string")))
    want = {(a, b, "negation") for (a, qa, ta), (b, qb, tb) in itertools.combinations(data, 2) if {*qa} & {*qb} and ta != tb}
    assert {tuple(r) for r in rows} == want and len(rows) == len(want) > N
    assert shuffled < 2 * N


def test_batch_scores_only_what_can_still_be_among_the_best(spark):
    """Claims of thirty unlike texts that all differ in their value: an observation needs those of its own text only."""
    words = [f"w{k}a w{k}b w{k}c" for k in range(30)]
    data = [(k, "f", words[k % 30], "is", None, "positive", "certain", float(1000 + k), "kg", None, None, None) for k in range(N)]
    frame = spark.createDataFrame(data, "id long, family_id string, subject string, predicate string, object string, polarity string, hedge string, value double, unit string, event_date string, version string, entity_id string")
    result = reconcile.plan_batch(frame.where("id % 50 = 0"), frame, itself=False)
    rows = {r.observation_id: r.matched_claim_id for r in result.collect()}
    near = lambda k: min(c for c in range(k % 30, N, 30) if c != k and abs(c - k) / (1000 + max(c, k)) <= 0.1)
    assert rows == {k: near(k) for k in range(0, N, 50)}
    todo, met = [result._jdf.queryExecution().executedPlan()], [0]
    while todo:
        node = todo.pop()
        name, children = node.getClass().getSimpleName(), node.children()
        todo += [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
        todo += [children.apply(k) for k in range(children.size())]
        if name.endswith("JoinExec"):
            met.append(node.metrics().apply("numOutputRows").value())
    assert max(met) < 2000  # pairs of texts; all pairs are 7,200
