"""Texts rearranged for fill-in-the-middle training, and the way back.

A text is cut into units (a run of ASCII letters, or any other single character) by the tokenizers library's ``Split``
pre-tokenizer with isolated matches of an expression; nothing is trained.  The number of offsets it supplies is the number of
units, and the offsets at two ranks, drawn from a hash of the document's id, end the prefix and the middle.  Offsets count
code points.  A long text is split a stretch at a time, each stretch ending where a unit must end, so memory holds the offsets
of one stretch only.

Null and empty texts, texts that contain a marker, and a drawn share of the others stay plain.  A null id is hashed like an empty
string; rows that repeat an id or a text are documents of their own and come out alike.  Very long texts are rearranged whole; a
single long run of letters is one unit.  Other columns, whatever their names, are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import slices

UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
#: Characters of a stretch; it goes on to the next character that is no letter, which is a unit.
STRETCH = 1 << 16
NO_LETTER = re.compile("[^A-Za-z]")


@lru_cache
def _splitter():
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(UNIT), "isolated").pre_tokenize_str


class Units:
    """The units of one text: how many, and where the first so many end."""

    def __init__(self, text: str, stretch: int = STRETCH):
        self.text, self.borders, self.counts = text, [0], []
        self.last: tuple[int, list] | None = None
        while (begin := self.borders[-1]) < len(text):
            found = NO_LETTER.search(text, begin + stretch - 1)
            self.borders.append(found.end() if found else len(text))
            self.counts.append(len(self._offsets(len(self.counts))))

    def _offsets(self, k: int) -> list:
        if self.last is None or self.last[0] != k:
            self.last = k, _splitter()(self.text[self.borders[k] : self.borders[k + 1]])
        return self.last[1]

    def __len__(self) -> int:
        return sum(self.counts)

    def end(self, rank: int) -> int:
        """The code point where the first ``rank`` units end."""
        for k, n in enumerate(self.counts):
            if rank <= n:
                return self.borders[k] + (self._offsets(k)[rank - 1][1][1] if rank else 0)
            rank -= n
        return len(self.text)


def draws(key: int | None, seed: int) -> list[int]:
    """Four 32-bit numbers from the hash of an id."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def rearranged(key: int | None, text: str, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, stretch: int = STRETCH) -> tuple[int, str, int | None, int | None, str]:
    """``(n, form, prefix_chars, middle_chars, output)`` of one text."""
    units = Units(text, stretch)
    n = len(units)
    h1, h2, h3, h4 = draws(key, seed)
    if not text or any(m in text for m in MARKERS) or h3 % 100 >= 100 - plain_percent:
        return n, "plain", None, None, text
    a, b = (units.end(rank) for rank in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n, form, prefix_chars, middle_chars, output)`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, last in slices(texts, 1 << 22):  # no more rearranged texts at once than these
                keys = batch.column(0).slice(first, last - first)
                rows = [rearranged(k, t or "", seed, plain_percent, spm_percent) for k, t in zip(keys.to_pylist(), texts[first:last], strict=True)]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], [id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    texts = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_text"))
    return texts.mapInArrow(run, f"`{id_col}` long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from.

    No marker is in a rearranged text, and markers cannot overlap each other, so the first ones found are those put in."""

    def between(begin: str, end: str | None) -> Column:
        at = F.locate(begin, output) + len(begin)
        return F.substring(output, at, F.locate(end, output) - at if end else F.length(output))

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
