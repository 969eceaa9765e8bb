"""Best-fit packing of tokenised documents into fixed-length sequences, after Martello-Toth dominance reduction.

Only the number of pieces of each length matters to the plan, so the instance that the driver solves is a histogram of at
most ``capacity`` counts, whatever the number of documents.  The reduction takes lengths from the longest down and fixes
for good the small sets that dominate every alternative: a piece beside which nothing fits, a pair that fills a sequence,
and a piece with the longest one that fits beside it when no two or more others could use that room better.  Best-fit
decreasing packs the rest.  The plan is a list of patterns with multiplicities; Spark then ranks the pieces of each length
and looks up, for (length, rank), the sequence and the offset.

Null and empty texts are documents of the end token alone.  Rows that repeat an id are documents of their own.  A null id
is kept as null.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

#: Words of a generation of the memo, and parts of words, which are asked for only where a word is new.
MEMO_WORDS, MEMO_PARTS = 350_000, 150_000
#: ASCII and Latin-1 letters, then ASCII marks: words that are their own pieces, whatever the normaliser does with others.
PLAIN_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:;=?@\\[-`{-~]*)")
#: Salts within one length, so that no task ranks all pieces of a length that a third of the documents may share.
SALTS = 128


class WordIds(dict):
    """Token ids of words (maximal runs without ASCII white space) as little-endian unsigned bytes, 32 bits or, ``short``, 16.

    A word that is not there yet is learnt when it is asked for; plain ones share the ids of their letters, in lower case, and of
    their marks.  Words met lately are kept in two generations: when the younger is full it becomes the older, from which words
    met again are taken back, so frequent words stay while memory is bounded."""

    def __init__(self, tokenizer_file: str, short: bool = False):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.older: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.older_parts: dict[str, bytes] = {}
        self.kind = "H" if short else "I"
        self.library = Tokenizer.from_file(tokenizer_file)
        self.normal, self.pieces, self.tokens = self.library.normalizer.normalize_str, self.library.pre_tokenizer.pre_tokenize_str, self.library.model.tokenize
        #: What the pre-tokenizer makes of each letter beyond ASCII that a plain word may have.
        self.spelled = {ord(c): self.pieces(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if c.isalpha()}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.older = self.copy()
            self.clear()
        found = self.older.get(word)
        if found is None:
            text = word.decode("utf-8", "surrogatepass")
            if word.isalpha() and word.islower():
                found = self._part(text)
            elif plain := PLAIN_WORD.fullmatch(text):
                found = self._part(plain[1].lower()) + self._part(plain[2]) if plain[2] else self._part(text.lower())
            else:
                found = self._ids(text)
        self[word] = found
        return found

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= MEMO_PARTS:
                self.parts, self.older_parts = {}, self.parts
            found = self.older_parts.get(part)
            if found is None:
                spelled = part if part.isascii() else part.translate(self.spelled)
                found = self._bytes([t.id for t in self.tokens(spelled)]) if part.isalpha() else self._ids(part)
            self.parts[part] = found
        return found

    def _ids(self, word: str) -> bytes:
        """The library's steps one by one where no special token can be in the word."""
        if "<" in word:
            return self._bytes(self.library.encode(word, add_special_tokens=False).ids)
        return self._bytes([t.id for p, _ in self.pieces(self.normal(word)) for t in self.tokens(p)])

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.kind, ids).tobytes()

    def forget(self) -> None:
        """Give the memory back, where a worker process goes on to other work."""
        for memo in (self, self.older, self.parts, self.older_parts):
            memo.clear()
        pa.default_memory_pool().release_unused()

    def of(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts`` (binary), the end id after each, and where each text's begin (one more than texts).

        Every distinct word of them is looked up once; its ids are then put wherever it stands."""
        lists = pc.ascii_split_whitespace(texts.fill_null(b"").cast(pa.string(), safe=False))
        borders = lists.offsets.to_numpy()
        words = lists.flatten().dictionary_encode()
        found = [self[w] for w in words.dictionary.cast(pa.binary()).to_pylist()]
        kind = np.dtype(f"<u{array(self.kind).itemsize}")
        known = np.frombuffer(b"".join(found), kind)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // kind.itemsize
        at = words.indices.to_numpy()
        size = sizes[at]
        before = np.concatenate([[0], np.cumsum(size)])
        text_of = np.repeat(np.arange(len(texts)), np.diff(borders))
        out = np.empty(before[-1] + len(texts), kind)
        begins = before[borders - borders[0]] + np.arange(len(texts) + 1)  # an end id for each text before it
        place = np.arange(before[-1])
        source = np.repeat((np.cumsum(sizes) - sizes)[at] - before[:-1], size) + place
        out[place + np.repeat(text_of, size)] = known[source]
        out[begins[1:] - 1] = end_id
        return out, begins


@lru_cache(1)
def word_ids(tokenizer_file: str, short: bool = False) -> WordIds:
    """One for all tasks of a worker process, so that frequent words are learnt once in it."""
    return WordIds(tokenizer_file, short)


def sized(texts: pa.Array, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` (binary) of about ``most`` bytes each; a longer text is a range of its own."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + most, side="right")))
        yield first, last
        first = last


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``: each text's ids and the end id, cut only where longer than ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(tokenizer_file)
        try:
            for batch in batches:
                rows: list[tuple] = []
                keys, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
                for first, last in sized(texts):
                    flat, begins = known.of(texts.slice(first, last - first), end_id)
                    ids = memoryview(flat).cast("B")
                    for key, begin, end in zip(keys[first:last], begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                        for n, at in enumerate(range(begin, end, capacity)):
                            to = min(at + capacity, end)
                            rows.append((key, n, at - begin, to - at, zlib.crc32(ids[4 * at : 4 * to])))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [id_col, "piece", "start", "length", "ids_crc32"])
        finally:
            known.forget()

    texts = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_text"))
    return texts.mapInArrow(run, f"`{id_col}` long, piece int, start long, length long, ids_crc32 long")


def _reachable(lengths: list[int], room: int) -> int:
    """Bit set of the sums, up to ``room``, of two or more of ``lengths`` (each as often as one likes)."""
    mask = (1 << (room + 1)) - 1
    single = sum(1 << x for x in lengths)
    total, more = single, 0
    while True:
        grown = 0
        for x in lengths:
            grown |= total << x
        grown &= mask
        if grown | more == more:
            return more
        more |= grown
        total |= grown


def plan_packing(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences follow each."""
    left = {k: n for k, n in histogram.items() if n}
    plan: list[tuple[tuple[int, ...], int]] = []

    def fix(pattern: tuple[int, ...], times: int) -> None:
        plan.append((pattern, times))
        for x in pattern:
            left[x] -= times
            if not left[x]:
                del left[x]

    for longest in sorted(left, reverse=True):
        while n := left.get(longest, 0):
            room = capacity - longest
            fits = sorted(x for x, c in left.items() if x <= room and (x != longest or c > 1))
            if not fits:
                fix((longest,), n)
                continue
            beside = fits[-1]
            pairs = n // 2 if beside == longest else min(n, left[beside])
            if beside < room and fits[0] + (fits[1] if len(fits) > 1 and left[fits[0]] == 1 else fits[0]) <= room and _reachable(fits, room) >> (beside + 1):
                break  # several shorter pieces might fill the room better: leave it to best fit
            fix((longest, beside), pairs)

    open_rooms: dict[int, list[list]] = {}
    rooms: list[int] = []

    def keep(pattern: tuple[int, ...], times: int) -> None:
        room = capacity - sum(pattern)
        if room not in open_rooms:
            bisect.insort(rooms, room)
            open_rooms[room] = []
        open_rooms[room].append([pattern, times])

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                full, rest = divmod(n, each)
                if full:
                    keep((length,) * each, full)
                if rest:
                    keep((length,) * rest, 1)
                break
            room = rooms[at]
            pattern, times = open_rooms[room].pop()
            if not open_rooms[room]:
                del open_rooms[room]
                rooms.pop(at)
            each = min(room // length, max(1, n // times))
            used = min(times, n // each)
            if used < times:
                keep(pattern, times - used)
            keep(pattern + (length,) * each, used)
            n -= each * used
    return plan + [(p, t) for groups in open_rooms.values() for p, t in groups]


def placements(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, end rank, first sequence, offset), sorted: where the pieces of a length go by rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for length in pattern:
            first = used.get(length, 0)
            rows.append((length, first, first + times, sequence, offset))
            used[length] = first + times
            offset += length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def place(pieces: DataFrame, capacity: int, keys: list[str]) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows that have a ``length`` from 1 to ``capacity``."""
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int"))
    counts = salted.groupBy("length", "_salt").count().collect()  # at most capacity * SALTS rows
    histogram: dict[int, int] = {}
    before = np.zeros((capacity + 1, SALTS), dtype=np.int64)
    for length, salt, n in sorted(map(tuple, counts)):
        before[length, salt] = histogram.get(length, 0)
        histogram[length] = histogram.get(length, 0) + n
    table = placements(plan_packing(histogram, capacity))
    names = pieces.columns
    starts = (table[:, 0] << 40) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64)
            length = get("length")
            rank = get("_rank") - 1 + before[length, get("_salt")]
            at = np.searchsorted(starts, (length << 40) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])],
                [*names, "sequence_id", "offset"],
            )

    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*keys)).cast("long"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema] + ["sequence_id long", "offset long"])
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset)`` for every piece of every document."""
    pieces = written(token_pieces(docs, tokenizer_file, capacity, end_id, id_col, text_col))
    return place(pieces, capacity, [id_col, "piece", "ids_crc32"])
