"""Words of whole texts as 64-bit hashes, a batch at a time.

A word is a run of ``[^\\x20\\x09-\\x0D]`` after A-Z are lower-cased.  Its hash is a polynomial over a fixed random
table of byte values modulo 2**64, taken for every word of a batch from one cumulative sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15
SLICE_BYTES = 1 << 18

_byte = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_space = np.zeros(256, dtype=bool)
_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers = [np.ones(0, dtype=np.uint64), np.ones(0, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((BASE, pow(BASE, -1, 2**64))):
            factors = np.full(n, base, dtype=np.uint64)
            factors[0] = 1
            _powers[k] = np.multiply.accumulate(factors)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def chain(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The hash of a sequence from that of its front and of its last word."""
    return mix(before * U(0xD6E8FEB86659FD93) + (after ^ (after >> U(32))) + U(0x632BE59BD9B4E019))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order, and where each text's words begin (one entry more than texts)."""
    encoded = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    joined = np.frombuffer(b"\n".join(encoded) + b"\n", dtype=np.uint8)
    edge = np.cumsum(np.fromiter((len(e) + 1 for e in encoded), np.int64, len(encoded)))
    space = _space[joined]
    inside = ~space
    before = np.empty_like(space)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(space & ~before)
    up, down = _power_tables(len(joined) + 1)
    total = np.cumsum(_byte[joined] * up[: len(joined)], dtype=np.uint64)
    front = np.where(starts > 0, total[starts - 1], U(0)) if len(starts) else np.zeros(0, np.uint64)
    hashes = mix((total[ends - 1] - front) * down[starts] + (ends - starts).astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64)
    return hashes, np.concatenate([[0], np.searchsorted(starts, edge)])


def slices(texts: list[str | None], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``most`` characters each, so that work on them keeps to bounded memory."""
    begin = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= most:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
