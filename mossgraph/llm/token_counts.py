"""Token counts by a finite-state tokenizer: a transducer whose transitions are annotated with the tokens they emit.

The transducer reads the characters of normalised text.  Its state is where the library's splitting stands (at a border,
in letters, in marks, behind an apostrophe) and, within a piece, the set of token boundaries that are still open, each with
the last token before it, the place reached in the trie of tokens and the tokens emitted so far relative to the others.  It
is determinised as characters arrive.  A boundary stays open only if the two tokens that meet there cannot merge, which is
what makes a segmentation the one that merging in rank order yields.

Every text is cut into chunks of a fixed number of characters, inside words too.  A chunk is a map from the state before it
to the state after it and a count: behind the first place where pieces part whatever came before, both are constant, and
only what lies before that place is read from the state that enters.  These maps compose associatively.  They are combined
across rows by Spark, in two levels of a scan by text and place, so that no character is read twice and no task gets more
than FAN maps of a text on the first level.

Null and empty texts count 0 bytes and 0 tokens.  Special-token strings inside texts count one token each, as the library
takes them by default.  Very long texts are cut like all others.  Rows are independent: repeated rows, null ids and any
other columns, whatever their names, are of no consequence, and there are no ties.  An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import parallelism

NEVER = 1 << 40
#: Characters of a chunk; maps of a text that one task combines on the first level.
CHUNK, FAN = 1 << 12, 256
MAP = ["n", "size", "found", "head", "count", "state"]
MEMO_WORDS = 1_000_000
#: ASCII letters, then ASCII marks: a word that is its own pieces, whatever the library's normaliser does with others.
PLAIN = re.compile(rb"([A-Za-z]*)([!-&(-/:;=?@\[-`{-~]*)")


class Transducer:
    """A lazily determinised transducer for one word at a time."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str):
        self.suffix = suffix
        self.pair_rank: dict[tuple[str, str], int] = {}
        made: dict[str, tuple[str, str, int]] = {}
        for rank, pair in enumerate(merges):
            left, right = pair if not isinstance(pair, str) else pair.split(" ")
            self.pair_rank.setdefault((left, right), rank)
            made.setdefault(left + right, (left, right, rank))
        self.right_edge: dict[str, list[tuple[str, int]]] = {}
        self.left_edge: dict[str, list[tuple[str, int]]] = {}
        self.trie: list[dict[str, int]] = [{}]
        self.token_at: list[str | None] = [None]
        for token in [t for t in vocabulary if t not in made] + list(made):
            left, right, rank = made.get(token, (None, None, 0))
            if left is not None:
                if left not in self.right_edge or right not in self.right_edge or self._merges(left, right, rank):
                    continue  # its own parts would merge otherwise: rank order never yields it
                self.right_edge[token] = [*[(t, min(r, rank) if r == NEVER else r) for t, r in self.right_edge[right]], (token, NEVER)]
                self.left_edge[token] = [*[(t, min(r, rank) if r == NEVER else r) for t, r in self.left_edge[left]], (token, NEVER)]
            else:
                self.right_edge[token] = self.left_edge[token] = [(token, NEVER)]
            node = 0
            for symbol in self._symbols(token):
                node = self.trie[node].setdefault(symbol, len(self.trie))
                if node == len(self.trie):
                    self.trie.append({})
                    self.token_at.append(None)
            self.token_at[node] = token
        self.apart = lru_cache(1 << 20)(lambda a, b: not self._merges(a, b, NEVER))
        self.states: dict[tuple, int] = {}
        self.hypotheses: list[tuple] = []
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.start = self._state(((None, 0, 0),))

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def _merges(self, a: str, b: str, before: int) -> bool:
        """Whether, in rank order, a part ending ``a`` joins a part beginning ``b`` ahead of rank ``before``."""
        for right, right_gone in self.right_edge[a]:
            for left, left_gone in self.left_edge[b]:
                rank = self.pair_rank.get((right, left))
                if rank is not None and rank < before and rank < right_gone and rank <= left_gone:
                    return True
        return False

    def _state(self, hypotheses: tuple) -> int:
        number = self.states.setdefault(hypotheses, len(self.hypotheses))
        if number == len(self.hypotheses):
            self.hypotheses.append(hypotheses)
            self.arcs.append({})
        return number

    def _step(self, state: int, symbol: str) -> tuple[list[tuple], tuple | None]:
        """The open boundaries after ``symbol``, and the boundary right behind it if a token may end there."""
        open_ones, ended = [], None
        for before, node, count in self.hypotheses[state]:
            node = self.trie[node].get(symbol)
            if node is None:
                continue
            if self.trie[node]:
                open_ones.append((before, node, count))
            token = self.token_at[node]
            if token is not None and (before is None or self.apart(before, token)):
                ended = (token, 0, count + 1)
        return open_ones, ended

    def arc(self, state: int, symbol: str) -> tuple[int, int]:
        """Next state and the tokens that the transition emits."""
        open_ones, ended = self._step(state, symbol)
        found = sorted([*open_ones, *([ended] if ended else [])], key=lambda h: (h[2], h[1], h[0] or ""))
        least = found[0][2]
        to = (self._state(tuple((b, n, c - least) for b, n, c in found)), least)
        self.arcs[state][symbol] = to
        return to


BORDER, LETTER, MARK, APOSTROPHE, SPACE, NUMBER = range(6)
#: The endings that the library splits from the word before.
ENDINGS = ("'s", "'t", "'m", "'d", "'re", "'ve", "'ll")


class TextTransducer:
    """The whole tokenizer over characters of normalised text.

    A state is (place, state of the piece's transducer, last symbol or characters still held back)."""

    START = (BORDER, 0, "")

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        with open(tokenizer_file, encoding="utf-8") as source:
            spec = json.load(source)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.library = Tokenizer.from_file(tokenizer_file)
        self.pieces = Transducer(spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"] or "")
        self.classes: dict[str, tuple[int, str]] = {}
        self.words: dict[bytes, int] = {}

    def normal(self, text: str) -> tuple[str, int]:
        """Normalised text, special tokens being white space, and how many of them there are."""
        found = 0
        for special in self.special:
            if special in text:
                found += text.count(special)
                text = text.replace(special, " ")
        return text.lower() if text.isascii() else self.library.normalizer.normalize_str(text), found

    def char(self, c: str) -> tuple[int, str]:
        """Class and byte symbols of a character, as the library takes it."""
        known = self.classes.get(c)
        if known is None:
            split = self.library.pre_tokenizer.pre_tokenize_str
            alone = split(c)
            if not alone:
                known = SPACE, ""
            else:
                kind = LETTER if len(split("a" + c)) == 1 else MARK if len(split("!" + c)) == 1 else NUMBER
                known = kind, alone[0][0]
            self.classes[c] = known
        return known

    def _read(self, piece: int, held: str, symbols: str) -> tuple[int, str, int]:
        """Read ``symbols`` behind the symbol held back; the last one is held back in its place."""
        total, arcs = 0, self.pieces.arcs
        for symbol in symbols:
            if held:
                to = arcs[piece].get(held) or self.pieces.arc(piece, held)
                piece, total = to[0], total + to[1]
            held = symbol
        return piece, held, total

    def _end(self, piece: int, held: str) -> int:
        """Tokens that the end of a piece emits."""
        final = held + self.pieces.suffix
        to = self.pieces.arcs[piece].get(final)
        if to is None:
            to = self.pieces.arcs[piece][final] = (-1, self.pieces._step(piece, final)[1][2])
        return to[1]

    def whole(self, text: str) -> int:
        """Tokens of a piece by itself."""
        piece, held, total = self._read(self.pieces.start, "", "".join(self.char(c)[1] for c in text))
        return total + self._end(piece, held)

    def feed(self, state: tuple, text: str) -> tuple[tuple, int]:
        """The state behind ``text`` and the tokens emitted on the way."""
        place, piece, held = state
        total = 0
        for c in text:
            kind, symbols = self.char(c)
            while True:
                if place == BORDER:
                    if kind == NUMBER:
                        total += self.whole(c)
                    elif c == "'":
                        place, held = APOSTROPHE, c
                    elif kind != SPACE:
                        place = kind
                        piece, held, n = self._read(self.pieces.start, "", symbols)
                        total += n
                    break
                if place == APOSTROPHE:
                    if held + c in ENDINGS:
                        total += self.whole(held + c)
                        place, held = BORDER, ""
                        break
                    if held == "'" and c in "rvl":
                        held += c
                        break
                    if held == "'" and kind == MARK:
                        place = MARK
                        piece, held, _ = self._read(self.pieces.start, "", held)
                        continue
                    total += self.whole("'")
                    if len(held) > 1:
                        place = LETTER
                        piece, held, _ = self._read(self.pieces.start, "", held[1])
                    else:
                        place, held = BORDER, ""
                    continue
                if kind == place:
                    piece, held, n = self._read(piece, held, symbols)
                    total += n
                    break
                total += self._end(piece, held)
                place, held = BORDER, ""
        return (place, piece if place in (LETTER, MARK) else 0, held), total

    def finish(self, state: tuple) -> int:
        """Tokens that the end of the text, or a border, emits in ``state``."""
        place, piece, held = state
        if place == APOSTROPHE:
            return sum(map(self.whole, (held[0], *held[1:])))
        return self._end(piece, held) if place != BORDER else 0

    def word(self, word: bytes) -> int:
        """Tokens from border to border over a run without ASCII white space; met before, it is one transition."""
        known = self.words.get(word)
        if known is None:
            if len(self.words) >= MEMO_WORDS:
                self.words.clear()
            state, known = self.feed(self.START, word.decode("utf-8", "surrogatepass"))
            known = self.words[word] = known + self.finish(state)
        return known

    def spelled(self, state: tuple) -> str:
        """A state in a form that any worker understands."""
        place, piece, held = state
        return json.dumps([place, self.pieces.hypotheses[piece] if place in (LETTER, MARK) else None, held])

    def state(self, spelled: str) -> tuple:
        place, open_ones, held = json.loads(spelled)
        return place, self.pieces._state(tuple(map(tuple, open_ones))) if open_ones else 0, held

    def rest(self) -> None:
        """Forget states where there are too many; none may be held then but spelled ones."""
        if len(self.pieces.arcs) > 400_000:
            self.pieces.states, self.pieces.hypotheses, self.pieces.arcs = {}, [], []
            self.pieces.start = self.pieces._state(((None, 0, 0),))


def sure_border(chunk: str, machine: TextTransducer) -> int:
    """The first place of ``chunk`` where pieces part whatever the state before it; its length if there is none."""
    before, former = BORDER, ""
    for k, c in enumerate(chunk):
        kind = machine.char(c)[0]
        if kind in (SPACE, NUMBER) or before == LETTER and kind == MARK and c != "'" or before == MARK and kind == LETTER and former != "'":
            return k
        before, former = kind, c
    return len(chunk)


#: The map of no text at all.
UNIT = ("", None, None)


def chunk_map(chunk: str, machine: TextTransducer) -> tuple[str, int | None, str | None]:
    """(what is read from the state that enters, then: tokens, state that leaves); None where there is no sure border."""
    at = sure_border(chunk, machine)
    if at == len(chunk):
        return chunk, None, None
    rest = chunk[at:].encode("utf-8", "surrogatepass")
    words = rest.split()
    tail = words.pop() if words and not rest[-1:].isspace() else b""
    count = sum(map(machine.word, words))
    state, n = machine.feed(machine.START, tail.decode("utf-8", "surrogatepass"))
    return chunk[:at], count + n, machine.spelled(state)


def compose(a: tuple, b: tuple, machine: TextTransducer) -> tuple:
    """The map of two neighbours; associative, with UNIT as its unit."""
    if a[1] is None:
        return a[0] + b[0], b[1], b[2]
    if b == UNIT:
        return a
    state, n = machine.feed(machine.state(a[2]), b[0])
    if b[1] is None:
        return a[0], a[1] + n, machine.spelled(state)
    return a[0], a[1] + n + machine.finish(state) + b[1], b[2]


def applied(found: tuple, machine: TextTransducer) -> int:
    """All tokens of a text whose map is ``found``: from the start to the end."""
    _, count, state = compose(("", 0, machine.spelled(machine.START)), found, machine)
    return count + machine.finish(machine.state(state))


def count_text(text: str, machine: TextTransducer, chunk: int | None = None) -> int:
    """Tokens of one text, by chunks (of CHUNK characters)."""
    normal, found = machine.normal(text)
    step, whole = chunk or CHUNK, UNIT
    for k in range(0, len(normal), step):
        whole = compose(whole, chunk_map(normal[k : k + step], machine), machine)
    return found + applied(whole, machine)


@lru_cache(maxsize=2)
def machine_of(tokenizer_file: str) -> TextTransducer:
    """One transducer for all tasks of a worker process."""
    return TextTransducer(tokenizer_file)


def count_tokens(docs: DataFrame, tokenizer_file: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", chunk: int | None = None) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of every whole text; null text: 0, 0, false."""
    step = chunk or CHUNK

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(tokenizer_file)
        for batch in batches:
            rows, taken = [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                machine.rest()
                text = text or ""
                normal, found = machine.normal(text)
                size = len(text.encode("utf-8", "surrogatepass"))
                for n, at in enumerate(range(0, max(len(normal), 1), step)):
                    rows.append((n, 0 if n else size, 0 if n else found, *chunk_map(normal[at : at + step], machine)))
                    taken.append(k)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            at = pa.array(taken, pa.int64())
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], ["row", "id", *MAP])

    def joined(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
        """One row for each run of rows with the same ``row`` and the same number of ``width`` maps."""
        machine, held = machine_of(tokenizer_file), None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(),) * 5 + (pa.string(), pa.int64(), pa.string())
            columns = zip(*rows, strict=True) if rows else [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["row", "id", *MAP])

        for batch in batches:
            done = []
            for row, key, n, size, found, *a_map in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                machine.rest()
                if held and held[0] == row and held[2] == n // width:
                    held = (row, key, n // width, held[3] + size, held[4] + found, *compose(tuple(held[5:]), tuple(a_map), machine))
                else:
                    if held:
                        done.append(held)
                    held = (row, key, n // width, size, found, *a_map)
            yield out(done)
        if held:
            yield out([held])

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(tokenizer_file)
        for batch in joined(batches, NEVER):
            _, key, _, size, found, *maps = (c.to_pylist() for c in batch.columns)
            counts = [f + applied(m, machine) for f, m in zip(found, zip(*maps, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(size, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    schema = "row long, id long, n long, size long, found long, head string, count long, state string"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("_text"))
    parts = parallelism(docs.sparkSession)
    maps = rows.mapInArrow(cut, schema)
    first = maps.repartition(parts, "row", F.floor(F.col("n") / FAN)).sortWithinPartitions("row", "n").mapInArrow(lambda batches: joined(batches, FAN), schema)
    second = first.repartition(parts, "row").sortWithinPartitions("row", "n")
    return second.mapInArrow(closed, f"`{id_col}` long, n_bytes long, n_tokens long, over_limit boolean")
