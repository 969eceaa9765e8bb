"""Operators that look at the whole corpus, against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import pytest

from mossgraph.llm import fingerprints, jaccard_join, line_dedup, lm_scoring, packing, quality_rules

P = pytest.importorskip("public_tokenizers")
TOKENIZER = P.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_statistics(docs, rows):
    q = quality_rules.PREFIX
    got = collections.Counter(tuple(r) for r in quality_rules.with_statistics(docs).select("doc_id", *[q + n for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]).collect())
    want = collections.Counter()
    for key, text, *_ in rows:
        text = text or ""
        w = WORD.findall(text)
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {p for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want[key, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)] += 1
    assert got == want


def test_rules_are_learnt_and_hold_out(spark, empty):
    random.seed(8)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(2, 8)))
    rows, labels = [], []
    for k in range(900):
        bad = k % 4 == 0
        text = " ".join(word() + ("$%&" if bad and random.random() < 0.5 else "") for _ in range(random.randint(20, 80)))
        rows.append((k, text))
        labels.append((k, 0 if bad else 1))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    rules = quality_rules.learn_rules(docs, known.where("doc_id < 600"))
    assert 1 <= len(rules) <= 3
    kept = {r.doc_id: r._q_kept for r in quality_rules.judged(docs, rules).where("doc_id >= 600").collect()}
    assert sum(kept[k] == (k % 4 != 0) for k in kept) >= 0.97 * len(kept)
    assert quality_rules.learn_rules(docs, known.limit(0)) == quality_rules.learn_rules(docs, known.where("quality = 1")) == []
    assert quality_rules.learn_rules(empty, known) == []
    assert quality_rules.judged(empty, []).count() == 0


def test_kept_rows_keep_clashing_columns(docs):
    clashing = docs.select("doc_id", "text", docs.lang.alias("_q_text"), docs.source.alias("_q_kept"))
    kept = quality_rules.kept_rows(clashing, [[("symbol_share", True, 0.1)]])
    want = quality_rules.judged(docs, [[("symbol_share", True, 0.1)]]).where("_q_kept")
    assert kept.columns == clashing.columns
    assert collections.Counter(map(tuple, kept.collect())) == collections.Counter(map(tuple, want.select("doc_id", "text", "lang", "source").collect()))


def brute_dedup(rows, least):
    """Deleted line numbers by (id, text), comparing every pair of lines."""
    split = {}
    for key, text, *_ in rows:
        if text is not None:
            split[key, text] = [(n, x) for n, x in enumerate(text.split("\n")) if WORD.search(x)]
    return split


@pytest.mark.parametrize("least", [4, 50])
def test_line_dedup(spark, docs, rows, empty, least):
    digest = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) AS h").collect()}
    split = brute_dedup(rows, least)
    order = sorted(split, key=lambda d: (d[0] is not None, d[0] or 0, digest[d[1]]))
    gone = collections.defaultdict(set)
    for a, d in enumerate(order):
        for k in range(len(split[d])):
            for b in range(a + 1):
                other = split[order[b]]
                for m in range(len(other) if b < a else k):
                    if split[d][k][1] != other[m][1] or (k and m and split[d][k - 1][1] == other[m - 1][1] and (b < a or m <= k)):
                        continue  # not the beginning of a maximal run
                    n = words = 0
                    while k + n < len(split[d]) and m + n < len(other) and split[d][k + n][1] == other[m + n][1]:
                        words += len(WORD.findall(split[d][k + n][1]))
                        n += 1
                    if words >= least:
                        gone[d].update(split[d][k + x][0] for x in range(n))
    want = collections.Counter()
    for key, text, *rest in rows:
        lost = gone[key, text]
        kept = None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in lost)
        want[key, kept, len(kept) if lost else rest[2], rest[3], rest[4], rest[5], 0 if text is None else text.count("\n") + 1, len(lost)] += 1
    got = line_dedup.dedup_lines(docs, least).select("doc_id", "text", "n_chars", "_text", "_gone", "_k", "n_lines", "n_removed").collect()
    assert collections.Counter(tuple(r) for r in got) == want
    assert sum(map(len, gone.values())) > 0
    assert line_dedup.dedup_lines(empty, least).count() == 0


def test_fingerprints(spark, docs, rows, empty):
    got = sorted(fingerprints.edited_likeness(docs).collect(), key=str)
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = []
    for k, (key, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        tail = len(text) // 4
        want.append((key, len(text), hashlib.sha256((text[: len(text) - tail] + after[:tail]).encode()).hexdigest()))
    assert sorted(want, key=str) == sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str)
    by_text = collections.defaultdict(set)
    for (key, text), r in zip(sorted(order, key=lambda x: str((x[0], len(x[1])))), sorted(got, key=lambda x: str((x.doc_id, x.n_chars))), strict=True):
        by_text[text].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in by_text.values()) and len(set.union(*by_text.values())) == len(by_text)
    unlike = [r for r in got if r.n_chars >= 150 and r.near_next < 0.5]
    assert len(unlike) > 30 and all(r.near_edited > r.near_next for r in unlike)
    assert fingerprints.edited_likeness(empty).count() == 0


def test_fingerprints_are_homomorphic(spark):
    rows = [("ab", "One. Two!\nThree."), ("ba", "Three.Two!\nOne. "), ("a", "One. Two!\n"), ("b", "Three.")]
    lanes = {r.k: r.lanes for r in fingerprints.fingerprints(spark.createDataFrame(rows, "k string, t string"), ["k"], "t").collect()}
    plus = [(x + y + 2**31) % 2**32 - 2**31 for x, y in zip(lanes["a"], lanes["b"], strict=True)]
    assert lanes["ab"] == plus and len(lanes["ab"]) == fingerprints.LANES
    frame = spark.createDataFrame([(lanes["ab"], lanes["b"])], "x array<long>, y array<long>")
    assert frame.select(fingerprints.remove(frame.x, frame.y)).first()[0] == lanes["a"]
    assert frame.select(fingerprints.combine(fingerprints.remove(frame.x, frame.y), frame.y)).first()[0] == lanes["ab"]


def test_language_model(docs, rows, empty):
    got = collections.defaultdict(list)
    for r in lm_scoring.score_held_out(docs).collect():
        got[r.doc_id].append(r)
    counts, texts = collections.Counter(), []
    for key, text, *_ in rows:
        w = [*(text or "").encode().lower().split(), None]
        held = zlib.crc32(("" if key is None else str(key)).encode()) % 5 == 1
        texts.append((key, w, held))
        if not held:
            counts.update(w)
    total, distinct = sum(counts.values()), len(counts)
    for key, w, held in texts:
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)
        assert any(r.held_out == held and r.n_tokens == len(w) and r.n_known == sum(counts[x] > 0 for x in w) and r.train_tokens == total and abs(r.base_score - base) < 1e-6 * len(w) and r.score < 0 for r in got[key]), key
    again = {(r.doc_id, r.n_tokens): r for r in lm_scoring.score_held_out(docs, broadcast_bytes=20_000).collect()}
    assert all(abs(again[k, r.n_tokens].score - r.score) < 1e-9 * r.n_tokens + 1e-9 for k, v in got.items() for r in v if len(v) == 1)
    assert lm_scoring.score_held_out(empty).count() == 0


def test_filter_reads_counts_back():
    import numpy as np

    keys = lm_scoring.mix(np.arange(1, 20_001, dtype=np.uint64))
    levels = 1 + np.arange(20_000) % 9
    size = int(levels.sum()) * lm_scoring.BITS_PER_ENTRY // 64 * 64
    bits = np.zeros(size, bool)
    for level in range(1, 10):
        for at in lm_scoring._bits(keys[levels >= level], level, size):
            bits[at] = True
    packed = np.packbits(bits, bitorder="little").tobytes()
    group = lm_scoring.Group({0: (len(packed), 0)}, [(0, packed, b"", b"")], 1)
    read = group.levels(keys)
    assert (read >= levels).all() and (read == levels).mean() > 0.97
    assert (group.levels(lm_scoring.mix(np.arange(50_001, 90_001, dtype=np.uint64))) == 0).mean() > 0.97


def test_packing_plan():
    random.seed(6)
    for _ in range(150):
        cap = random.choice([10, 20, 64])
        histogram = {x: random.randint(0, 9) for x in range(1, cap + 1) if random.random() < 0.6}
        plan = packing.plan_packing(histogram, cap)
        used = collections.Counter()
        for pattern, times in plan:
            assert sum(pattern) <= cap and times > 0
            for x in pattern:
                used[x] += times
        assert used == {k: v for k, v in histogram.items() if v}
        bins = []
        for x in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
            fit = min((b for b in bins if b[0] >= x), default=None)
            if fit is None:
                bins.append([cap - x])
            else:
                fit[0] -= x
        assert sum(t for _, t in plan) <= len(bins)  # never worse than best-fit decreasing


def test_packing(docs, rows, empty):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(TOKENIZER)
    want = collections.Counter()
    for key, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 128)):
            part = ids[at : at + 128]
            want[key, n, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += 1
    got = packing.pack_documents(docs, TOKENIZER, capacity=128).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 128
    assert len(by) <= 1.05 * math.ceil(sum(r.length for r in got) / 128) + 1
    assert packing.pack_documents(empty, TOKENIZER).count() == 0


def brute_groups(rows, width, num, den):
    sets, parent = [], {}
    for key, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append((key, {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())))

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations([s for s in sets if s[0] is not None], 2):
        same = len(x & y)
        if same and den * same >= num * (len(x) + len(y) - same):
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    return collections.Counter((k, len(s), None if k is None else root(k)) for k, s in sets)


@pytest.mark.parametrize("long_block", [512, 3])
def test_jaccard_join(spark, docs, rows, empty, monkeypatch, long_block):
    monkeypatch.setattr(jaccard_join, "LONG", long_block)
    random.seed(12)
    base = " ".join(random.choice("abcdefghijklmnop") * random.randint(1, 3) for _ in range(120)).split()
    near = []
    for k in range(40):
        words = list(base)
        for _ in range(random.randint(0, 4)):
            words[random.randrange(len(words))] = f"edit{random.randrange(9)}"
        near.append((1000 + k, " ".join(words)))
    more = spark.createDataFrame(near, "doc_id long, text string")
    everything = docs.select("doc_id", "text").union(more)
    all_rows = [*[r[:2] for r in rows], *near]
    got = collections.Counter(tuple(r) for r in jaccard_join.link_groups(everything).collect())
    assert got == brute_groups(all_rows, 3, 90, 100)
    assert jaccard_join.link_groups(empty).count() == 0


def test_one_of_each_group(docs, rows):
    kept = jaccard_join.one_of_each_group(docs)
    assert kept.schema == docs.schema
    want = collections.Counter()
    groups = {k: root for k, _, root in brute_groups(rows, 5, 80, 100)}
    for r in rows:
        if r[0] is None or groups[r[0]] == r[0]:
            want[r[:2]] += 1
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == want


def test_blocks_of_many_pairs_are_dealt_out_and_give_the_same(docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PAIRS", 1)
    monkeypatch.setattr(jaccard_join, "FEW", 0)  # no rounds of pivots: all pairs come from the blocks
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.link_groups(docs, 3, 60, 100).collect())
    assert got == brute_groups(rows, 3, 60, 100)


def test_language_model_weighs_all_training_texts(spark, monkeypatch):
    """Groups of copies that alone have the tokens of their level: each keeps its pair estimates, in tables of any size."""
    rows = [(-k, f"w{k}") for k in range(1, 4001)] + [(j, f"p{j} q{j}") for j in range(4, 10) for _ in range(2**j)]
    docs = spark.createDataFrame(rows, "k long, t string").repartition(5)
    evidence, choose = [], lm_scoring.Estimates.choose_weights
    monkeypatch.setattr(lm_scoring.Estimates, "choose_weights", lambda self, kinds, counts: (evidence.append(int(counts.sum())), choose(self, kinds, counts))[-1])
    got = lm_scoring.score_texts(docs, docs, ["k"], "t").where("k > 0").distinct().collect()
    total, distinct = 2 * 4000 + 3 * sum(2**j for j in range(4, 10)), 4000 + 2 * 6 + 1
    assert evidence == [total]
    assert sorted(r.k for r in got) == list(range(4, 10))
    for r in got:
        first = math.log10((2**r.k + 0.5) / (total + 0.5 * (distinct + 1)))
        assert r.train_tokens == total and r.score > first - 0.3, r


def test_levels_without_evidence_take_the_nearest_weight():
    import numpy as np

    means = [np.arange(lm_scoring.LEVELS) ** 2.0] * 2
    estimates = lm_scoring.Estimates(means, 1000, 100, 50)
    kind = lambda context, two, one: (context * lm_scoring.LEVELS + two) * lm_scoring.LEVELS + one
    estimates.choose_weights(np.array([kind(10, 10, 3), kind(20, 0, 30)]), np.array([5, 5]))
    assert set(estimates.weights[1:16]) == {0.97} and set(estimates.weights[16:]) == {0.0} and estimates.weights[0] == 0.0
