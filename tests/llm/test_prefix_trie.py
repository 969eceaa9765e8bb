"""The trie of conversation prefixes against one built turn by turn, and its SQL."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import pytest

from mossgraph.llm import prefix_trie, queries, storage

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "n_words"]
SCHEMA = "conv_id long, turn long, role string, text string, conv int, node string, n int, _turn int"


def brute(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members = collections.defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    words = lambda p: len(WORD.findall(p[-1][1])) if p else 0
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(cs) - 1) * words(p)
    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(whole[c]) == len(p)))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest(), words(p)))
    return sorted(out, key=str)


def made(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA).repartition(5)
    got = prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.placed_turns(frame)))
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()), key=str)


def conversations(seed, n=120, longest=12):
    random.seed(seed)
    rows = []
    for c in random.sample(range(n * 2), n):
        for t in range(random.choice([1, 2, 3, longest])):
            rows.append((c, t, random.choice(["user", "assistant"]), random.choice(["a b", "c", "one two three", ""])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_one_built_turn_by_turn(spark, seed):
    rows = conversations(seed)
    assert made(spark, rows) == brute(rows)


def test_nulls_ties_repeated_rows_and_no_rows(spark):
    rows = conversations(3, 30)
    texts = [(40, None, "user", "first"), (40, 0, None, None), (40, 1, "user", "é 🙂 x \x0b y"), (41, 0, "u", "same"), (41, 1, "u", "same"), (41, 1, "u", "same"), (60, 5, "u", "w " * 50_000)]
    rows = [r for r in rows if r[0] not in (40, 41, 60)] + texts
    assert made(spark, [*rows, (None, 0, "user", "of nobody")]) == brute(rows)
    assert made(spark, []) == []


def test_long_conversations_are_chained_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    rows = []
    for c, n in ((0, 70), (20, 70), (21, 69), (22, 33), (43, 4), (40, 8), (47, 9)):
        rows += [(c, t, "u", f"t{t if t != 50 or c != 20 else 'other'}") for t in range(n)]
    assert made(spark, rows) == brute(rows)


def test_one_key_with_most_rows_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(storage, "HOT", 20)
    monkeypatch.setattr(prefix_trie, "MEMBERS", 7)
    rows = [(100, t, "u", f"long {t}") for t in range(300)]  # a conversation, a first turn and a whole conversation that many rows share
    rows += [(c, t, "u", f"same {t}") for c in range(101, 400) for t in range(5)]
    rows += [(c, t, "u", "hello" if not t else f"{c}") for c in range(400, 700) for t in range(2)]
    assert made(spark, rows) == brute(rows)


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{FOLDER}/conversations.parquet'")
    want = con.execute(queries.ORACLE_SQL["op11_prefix_trie"])
    assert [c[0] for c in want.description] == COLUMNS
    got = sorted(map(tuple, queries.op11_prefix_trie(spark, FOLDER).collect()), key=str)
    rows = con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    con2 = sorted(con.execute(queries.ORACLE_SQL["op11_prefix_trie"]).fetchall(), key=str)
    assert got == con2 == brute(rows)
