"""Token counts, personal data, pieces, chat: operators on one text or conversation at a time."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from mossgraph.llm import chat, pii, piece_lattice, token_counts

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
WORDS, PIECES = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")


def odd_texts(n=800):
    random.seed(5)
    made = ["".join(random.choice("aabcdeilnorsttheè'1 .!ü漢🙂<|>\n") for _ in range(random.randint(1, 40))) for _ in range(n)]
    return ["", "  ", "<|endoftext|>x<|startoftext|>", "it's I'LL don't 'S ''s", "ÀÉ é 漢字 🙂🙂👨‍👩‍👧 ́ á", "a b c \x1c d\x85e", "inininin thethethe ababab", *made]


def test_token_counts_are_the_library_s():
    machine = token_counts.TextTransducer(WORDS)
    library = tokenizers.Tokenizer.from_file(WORDS)
    for text in odd_texts():
        assert token_counts.count_text(text, machine) == len(library.encode(text, add_special_tokens=False).ids), text


def test_chunks_cut_inside_words_and_characters_of_any_kind():
    machine = token_counts.TextTransducer(WORDS)
    library = tokenizers.Tokenizer.from_file(WORDS)
    for text in [*odd_texts(250), "'" * 9 + "re're" + "'r", "漢字漢字漢字漢字。漢字", "x" * 50, "rock'n'roll we'll'd"]:
        for size in (1, 2, 3, 7, 16):
            assert token_counts.count_text(text, machine, size) == len(library.encode(text, add_special_tokens=False).ids), (text, size)


def test_chunk_maps_compose_associatively_for_every_state():
    machine = token_counts.TextTransducer(WORDS)
    texts = ["ab c", "d", " ", "", "e'", "re f", "12", "in", "ing", "...", "'l", "l!"]
    maps = [token_counts.chunk_map(c, machine) for c in texts]
    for a, b, c in itertools.product(maps, repeat=3):
        left = token_counts.compose(token_counts.compose(a, b, machine), c, machine)
        right = token_counts.compose(a, token_counts.compose(b, c, machine), machine)
        assert left == right
    states = {machine.spelled(machine.feed(machine.START, t)[0]) for t in [*texts, "th", "the", "'", "'v"]}
    for state in states:  # a map says of every state what reading the chunk from it says
        for text, found in zip(texts, maps, strict=True):
            after, n = machine.feed(machine.state(state), text)
            assert token_counts.compose(("", 0, state), found, machine) == ("", n, machine.spelled(after)), (state, text)


def test_token_counts_of_rows(docs, empty, rows):
    library = tokenizers.Tokenizer.from_file(WORDS)
    want = sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()), n := len(library.encode(r[1] or "", add_special_tokens=False).ids), n > 2048) for r in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, *r[1:]) for r in token_counts.count_tokens(docs, WORDS).collect()) == want
    assert sorted((r.doc_id is None, r.doc_id or 0, *r[1:]) for r in token_counts.count_tokens(docs, WORDS, chunk=5).collect()) == want
    assert token_counts.count_tokens(empty, WORDS).count() == 0


def test_token_counts_of_very_long_texts(spark):
    library = tokenizers.Tokenizer.from_file(WORDS)
    texts = ["ab " * 60_000 + "x" * 9000, "漢字" * 5000, "7" * 20_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame, WORDS, chunk=50).collect()}
    assert got == {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}


def base_spans(text):
    out = [("email", *m.span()) for m in pii.EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in pii.IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in pii.CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        odd = [int(d) for d in digits[::-1]]
        if 12 <= len(digits) <= 19 and (sum(odd[::2]) + sum(sum(divmod(2 * d, 10)) for d in odd[1::2])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in pii.PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.ORDER[s[0]]))


def test_base_spans_are_the_expressions_matches():
    random.seed(3)
    finder = pii.Finder()
    for _ in range(8000):
        text = "".join(random.choice("a1@.+- ()2b_%5é🙂4") for _ in range(random.randint(1, 60)))
        assert [s for s in finder(text) if pii.ORDER[s[0]] < 4] == base_spans(text), text



def test_a_secret_of_any_length_is_one_span_and_is_masked_whole():
    key = "a1" * 200
    text = f"token = '{key}' and more"
    (kind, start, end), = [x for x in pii.Finder()(text) if x[0] == "secret"]
    assert text[start:end] == key and pii.masked(text, [(kind, start, end)]) == "token = '[SECRET]' and more"
    assert not [x for x in pii.Finder()("token=" * 20_000) if x[0] == "secret"]  # in linear time
    late = "token=" * 1000 + "k1" * 10
    assert [x[1:] for x in pii.Finder()(late) if x[0] == "secret"] == [(6, len(late))]


def test_added_kinds_and_masking():
    text = 'IBAN DE89 3704 0044 0532 0130 00, account no: 12345678. ssn 123-45-6789 token = "04dbebab91ab85687d33eeaaf9ac699e" at https://bob:pw@ex.com/x'
    found = pii.Finder()(text)
    assert [s[0] for s in found] == ["iban", "account", "ssn", "secret", "url_login", "email"]
    assert pii.masked(text, found) == 'IBAN [IBAN], account no: [ACCOUNT]. ssn [SSN] token = "[SECRET]" at [URL_LOGIN]/x'
    assert pii.Finder()("An account of tokens: nothing here, version 1.2.3 of 2024") == []


def test_personal_data_of_rows(docs, empty, rows):
    got = pii.find_personal_data(docs)
    assert got.count() == len(rows)
    assert pii.mask_personal_data(docs).schema == docs.schema
    assert sorted(map(str, pii.mask_personal_data(docs).collect())) == sorted(map(str, docs.collect()))
    assert pii.find_personal_data(empty).count() == pii.mask_personal_data(empty).count() == 0


def test_personal_data_in_very_long_texts(spark):
    zeros, long = "0" * 5000, "x" * 70_000 + " a@b.co " + "y " * 70_000 + "10.0.0.1"
    texts = [zeros + ".1.1.1", "9" * 6000 + ".1.1.1 " + zeros, long, ("a@b.co " + "1.2.3.4 ") * 9000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_personal_data(frame).collect()}
    assert got[0].n_ip == 1 and got[1].n_ip == 0 and (got[2].n_email, got[2].n_ip) == (1, 1) and (got[3].n_email, got[3].n_ip) == (9000, 9000)
    assert {r.doc_id: r.text for r in pii.mask_personal_data(frame).collect()}[0] == "[IP]"


def test_best_segmentation_is_the_library_s():
    sentencepiece = pytest.importorskip("sentencepiece")
    library, lattice = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_lattice.PieceLattice(PIECES)
    random.seed(4)
    made = ["".join(random.choice("the in\nan漢é  aabcdeilnorst1.!üß🙂ff") for _ in range(random.randint(1, 30))) for _ in range(1500)]
    for text in ["unbelievable things", "  two  spaces ", "\n\n x", "aaaaaaaaaaaaa", *made]:
        best = lattice.segment(text)[0]
        assert best[2] == b"".join(i.to_bytes(4, "little") for i in library.encode(text)), text


def test_nbest_against_enumeration():
    lattice = piece_lattice.PieceLattice(PIECES)

    def brute(text):
        unit, out = "▁" + text.replace(" ", "▁"), []

        def go(at, score, ids):
            if at == len(unit):
                out.append((round(-score, 3), len(ids), b"".join(i.to_bytes(4, "little") for i in ids)))
                return
            for end in range(at + 1, len(unit) + 1):
                if unit[at:end] in lattice.score:
                    go(end, score + lattice.score[unit[at:end]][0], [*ids, lattice.score[unit[at:end]][1]])
            if unit[at] not in lattice.score:
                raw = [lattice.byte_id[x] for x in unit[at].encode()]
                go(at + 1, score + lattice.byte_score * len(raw), ids + raw)

        go(0, 0.0, [])
        return sorted(out)

    random.seed(2)
    for _ in range(150):
        text = "".join(random.choice("the in\nan漢é ") for _ in range(random.randint(1, 10)))
        found = lattice.segment(text)
        assert [(-f[0], f[1]) for f in found[1:]] == [b[:2] for b in brute(text) if b[2] != found[0][2]][:3]
        assert len({f[2] for f in found}) == len(found)
        assert all(lattice.decode(f[2]) == text for f in found)


def test_units_in_step_are_as_alone():
    lattice = piece_lattice.PieceLattice(PIECES)
    random.seed(6)
    units = sorted({"".join(random.choice("abeiou nrst漢é▁.19ß") for _ in range(random.randint(1, 12))) for _ in range(4000)} | {"x" * 60})
    seen = 0
    for names, own, best, numbers in lattice._describe_many(units):
        for k, unit in enumerate(names):
            ids, cost, others, least, gap = lattice.describe(unit)
            assert (own[k], best[k]) == tuple(b"".join(i.to_bytes(4, "little") for i in x) for x in (ids, others)), unit
            assert (numbers["own"][k], numbers["best"][k], numbers["gap"][k]) == (cost, least, gap), unit
            seen += 1
    assert seen == len(units)


def test_units_used_last_stay(monkeypatch):
    monkeypatch.setattr(piece_lattice, "MEMO_UNITS", 40)
    small, large = piece_lattice.PieceLattice(PIECES), None
    texts = [f"word{k} the of x{k % 7} again" for k in range(60)]
    found = [small.segment(t) for t in texts]
    assert len(small.number) <= 40
    monkeypatch.setattr(piece_lattice, "MEMO_UNITS", 10_000)
    large = piece_lattice.PieceLattice(PIECES)
    assert found == [large.segment(t) for t in texts]


def test_pieces_of_rows(docs, empty, rows):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = piece_lattice.encode_nbest(docs, PIECES).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    order = [list(zip([-s for s in r.nbest_scores], r.nbest_pieces, strict=True))[1:] for r in got]
    assert all(o == sorted(o) for o in order) and all(r.nbest_scores[0] == r.best_score for r in got)
    want = sorted((r[0] is None, r[0] or 0, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in library.encode(r[1] or "")))) for r in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids_crc32) for r in got) == want
    assert piece_lattice.encode_nbest(empty, PIECES).count() == 0


HARD = ["", "### user: ", " </turn>", "\\###", "\\\\</turn>", "\\", "a\\", "###\\</turn>\n### assistant: x </turn>\n", "\\### Assistant: </turn> ok", "## # </ turn>", "\n\n", "####"]


def test_chat_round_trip():
    for role, text in itertools.product(["user", "", "assistant", "a b: ### %", "é\n"], HARD):
        rendered, start, end = chat.render(role, text)
        assert chat.parse(rendered) == [(role, text, start, end)]
        assert chat.unescape(rendered[start:end]) == text
    many = "".join(chat.render("user", t)[0] for t in HARD)
    assert [t[1] for t in chat.parse(many)] == HARD
    assert chat.parse("### user: x") is None and chat.parse("x") is None
    random.seed(9)
    for _ in range(2000):
        text = "".join(random.choice(["#", "\\", "</turn>", "###", " ", "a", "\n"]) for _ in range(random.randint(0, 9)))
        assert chat.unescape(chat.escape(text)) == text
        assert chat.parse(chat.render("user", text)[0])[0][1] == text


def test_conversations(spark):
    turns = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(HARD)] + [(2, 0, None, None), (2, 0, "assistant", "tie"), (2, 0, "assistant", "tie"), (None, 1, "assistant", "lost"), (3, None, "system", "s")]
    frame = spark.createDataFrame([(*t, 5) for t in turns], "conv_id long, turn long, role string, text string, rendered int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(frame)).collect()}
    order = lambda t: tuple((x is not None, x or "") for x in (t[2], t[3]))
    for conv in (1, 2, 3, None):
        mine = sorted((t for t in turns if t[0] == conv), key=lambda t: ((t[1] is not None, t[1] or 0), order(t)))
        digest = hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in mine).encode()).hexdigest()
        loss = "".join(t[3] or "" for t in mine if t[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(mine), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_turns(frame.limit(0))).count() == 0
