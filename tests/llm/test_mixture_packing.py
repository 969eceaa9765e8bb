"""Mixture-controlled packing: the schedule against a walk through all rounds, and whole packed tables."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mossgraph.llm import mixture_packing
from mossgraph.llm.mixture_packing import Schedule

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
WORDS = P.path("word_bpe_49k.json")


def walk(totals, weights, schedule):
    """Round by round with deficit counters: each id goes to the queue that is furthest behind, what is left is carried on."""
    sent, rounds = [0] * len(totals), []
    for k in range(schedule.rounds):
        size = int(schedule.begins(np.array([k + 1]))[0] - schedule.begins(np.array([k]))[0])
        before = list(sent)
        for _ in range(size):
            q = min((q for q in range(len(totals)) if sent[q] < totals[q]), key=lambda q: ((sent[q] + 0.5) / weights[q], q))
            sent[q] += 1
        rounds.append([b - a for a, b in zip(before, sent, strict=True)])
    return rounds


@pytest.mark.parametrize("seed", range(25))
def test_schedule_equals_a_walk_through_all_rounds(seed):
    random.seed(seed)
    n = random.randint(1, 9)
    totals = [random.randint(1, 200) for _ in range(n)]
    weights = [float(t) for t in totals] if seed % 2 else [random.random() + 0.01 for _ in range(n)]
    schedule = Schedule(totals, weights, 2 ** random.randint(0, 6))
    want = walk(totals, weights, schedule)
    queue, begin, length = [], [], []
    for q, total in enumerate(totals):
        at = 0
        while at < total:
            size = min(random.randint(1, 90), total - at)
            queue.append(q), begin.append(at), length.append(size)
            at += size
    order = list(range(len(queue)))
    random.shuffle(order)
    queue, begin, length = (np.array(x)[order] for x in (queue, begin, length))
    which, start, size, rounds, offset = schedule.pieces(queue, begin, length)
    got = [[0] * n for _ in want]
    places = collections.Counter()
    for w, s, k, r, o in zip(which, start, size, rounds, offset, strict=True):
        got[r][queue[w]] += k
        places.update((int(r), int(o + i)) for i in range(k))
    assert got == want
    assert set(places.values()) <= {1} and set(places) == {(r, i) for r, x in enumerate(want) for i in range(sum(x))}
    assert [s for w, s in sorted(zip(which, start, strict=True)) if s == 0] == [0] * len(queue)
    if seed % 2:
        assert np.abs(schedule.deficits(np.arange(schedule.rounds + 1))).max() <= n / 2


def test_shares_hold_in_every_round_and_queues_that_ran_out_leave_theirs_to_the_others():
    schedule = Schedule([60_000, 30_000, 10_001], [6.0, 3.0, 1.0001], 2048)
    sent = np.diff(schedule.taken(schedule.begins(np.arange(schedule.full + 1))), axis=0)
    assert np.abs(sent - np.array([0.6, 0.3, 0.1]) * 2048).max() < 3
    schedule = Schedule([10_000, 100_000], [0.5, 0.5], 1024)
    sent = np.diff(schedule.taken(schedule.begins(np.arange(schedule.full + 1))), axis=0)
    assert sent[:19].tolist() == [[512, 512]] * 19 and sent[-1].tolist() == [0, 1024]


def test_a_document_of_very_many_rounds_is_laid_out_in_parts(monkeypatch):
    monkeypatch.setattr(mixture_packing, "ROUNDS", 4)
    schedule = Schedule([100_000, 5_000], [100_000.0, 5_000.0], 64)
    which, start, size, rounds, offset = schedule.pieces(np.array([1, 0]), np.array([0, 0]), np.array([5_000, 100_000]))
    for k, total in ((0, 5_000), (1, 100_000)):
        mine = which == k
        assert start[mine][0] == 0 and (start[mine][1:] == (start[mine] + size[mine])[:-1]).all() and size[mine].sum() == total
    covered = sorted((r, o, o + n) for r, o, n in zip(rounds, offset, size, strict=True))
    for (r, _, end), (s, begin, _) in zip(covered, covered[1:]):
        assert begin == (end if r == s else 0)


def check(packed, texts, capacity, end_id=1):
    """Every id in exactly one piece, sequences without gaps, and padding of none but full or power-of-two lengths."""
    library = tokenizers.Tokenizer.from_file(WORDS)
    want = collections.Counter()
    for key, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, end_id], "<u4")
        want[key, len(ids), zlib.crc32(ids.tobytes())] += 1
    by_key, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in packed:
        by_key[r.doc_id, r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length > 0
    got = collections.Counter()
    for (key, n), pieces in by_key.items():
        copies = sum(r.length for r in pieces) // n
        if copies == 1:
            pieces.sort(key=lambda r: r.start)
            assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1]]
            got[key, n, zlib.crc32(b"".join(r.ids for r in pieces))] += 1
        else:  # repeated rows: only how many
            got.update({x: want[x] for x in want if x[:2] == (key, n)})
    assert got == want
    sizes = []
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]]
        sizes.append(sum(n for _, n in parts))
    assert all(n & (n - 1) == 0 and n <= capacity for n in sizes) and len(sizes) == len([b for b in bin(sum(sizes) % capacity) if b == "1"]) + sum(sizes) // capacity
    return by_sequence


@pytest.mark.parametrize("capacity", [32, 2048])
def test_whole_tables(spark, docs, rows, empty, capacity):
    packed = mixture_packing.pack_mixture(docs, WORDS, capacity).collect()
    check(packed, [(r[0], r[1]) for r in rows], capacity)
    assert mixture_packing.pack_mixture(empty, WORDS, capacity).count() == 0


def test_mixture_of_sources_with_targets_nulls_and_clashing_columns(spark):
    random.seed(4)
    rows = [(k, " ".join(random.choice("abcdefgh") * random.randint(1, 3) for _ in range(random.randint(0, 60))), (None, "a", "b", "b", "b", "c")[k % 6], 1, 2) for k in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, ids int, _queue int").repartition(7)
    packed = mixture_packing.pack_mixture(frame, WORDS, 256).collect()
    check(packed, [r[:2] for r in rows], 256)
    total = collections.Counter()
    mixed = collections.defaultdict(collections.Counter)
    for r in packed:
        total[r.source] += r.length
        mixed[r.sequence_id][r.source] += r.length
    every = sum(total.values())
    assert set(total) == {None, "a", "b", "c"}
    assert all(abs(n[s] - 256 * total[s] / every) < 3 for n in mixed.values() if sum(n.values()) == 256 for s in total)
    packed = mixture_packing.pack_mixture(frame, WORDS, 256, targets={None: 0.4, "a": 0.2, "b": 0.2, "c": 0.2}).collect()
    check(packed, [r[:2] for r in rows], 256)
    first = collections.Counter()
    for r in packed:
        if r.sequence_id < 20:
            first[r.source] += r.length
    assert abs(first[None] - 0.4 * 256 * 20) < 3 and abs(first["b"] - 0.2 * 256 * 20) < 3


def test_more_sources_than_queues_and_sums_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mixture_packing, "QUEUES", 3)
    monkeypatch.setattr(mixture_packing, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(mixture_packing, "BLOCK", 2)
    rows = [(k, "a b c " * (k % 9), f"s{k % 40}" if k % 2 else "most") for k in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(9)
    packed = mixture_packing.pack_mixture(frame, WORDS, 128).collect()
    check(packed, [r[:2] for r in rows], 128)
    mixed = collections.defaultdict(collections.Counter)
    for r in packed:
        mixed[r.sequence_id][r.source] += r.length
    share = sum(n["most"] for n in mixed.values()) / sum(sum(n.values()) for n in mixed.values())
    assert all(abs(n["most"] - share * 128) < 3 for n in mixed.values() if sum(n.values()) == 128)


def test_one_source_with_most_rows_is_spread(spark):
    frame = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("hot").alias("source")).repartition(8)
    packed = mixture_packing.pack_mixture(frame, WORDS)
    assert packed.rdd.getNumPartitions() > 1
    sizes = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sorted(r.n for r in sizes)[-5:] == [2048] * 5
