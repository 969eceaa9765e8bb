"""Tokenised documents packed into sequences that each hold every source in its target proportion, by deficit round-robin.

Every source is a queue of its documents' ids.  A sequence is one round: each queue's deficit grows by the queue's share of the
sequence, the queue sends as many ids as its deficit has come nearest to, and what it sent too little or too much is carried
to the next round; a queue that has run out leaves its share to the others.  Without targets a source's share is its own part
of all ids, so that the queues run out together and the last sequence is mixed like the first.  Documents are cut where a
queue's turn ends.  All sequences are full; the ids left in the end go into sequences whose lengths are powers of two, so none
needs padding.

What a queue has sent before a given round depends on the sizes and shares of the queues alone: ids leave in the order of
(place in the queue + 1/2) / share, and a round ends after every so many of them.  ``Schedule`` computes it for any round, so
tasks begin at any round with the deficits that the rounds before it carry over, and no task walks through all of them.  Spark
finds each document's place in its queue: by task and source, then by sums over tasks.

At most ``QUEUES`` queues: beyond that the largest sources have one each and all others share the last, in table order.
Documents of a queue follow each other in the order of the table's partitions, and one that takes very many rounds is laid out
a part at a time.  Null and empty texts are documents of the end token alone; a null source is a source; rows that repeat an
id are documents of their own and a null id stays null.  Other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packing import sized, word_ids
from .storage import discard, written

QUEUES = 512
#: Tasks whose sums are added up together; rows of sums that are sent to every task, beyond which both sides are shuffled.
BLOCK, BROADCAST_ROWS = 256, 200_000
#: Rounds whose ends are computed at once, and ids that are laid out at once.
ROUNDS, SLICE_IDS = 4096, 1 << 20


class Schedule:
    """What each of some queues of ``totals`` ids, with positive ``weights``, has sent when a round begins."""

    def __init__(self, totals: list[int], weights: list[float], capacity: int):
        self.totals, self.weights, self.capacity = np.array(totals, dtype=np.int64), np.array(weights, dtype=np.float64), capacity
        self.full, rest = divmod(int(self.totals.sum()), capacity)
        ends = np.cumsum([1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], dtype=np.int64)
        self.tail = self.full * capacity + np.concatenate([[0], ends]).astype(np.int64)
        self.rounds = self.full + len(ends)
        done = self.totals / self.weights
        self.times = np.concatenate([[0.0], np.sort(done)])
        self.sent = np.array([np.minimum(self.totals, t * self.weights).sum() for t in self.times])

    def begins(self, rounds: np.ndarray) -> np.ndarray:
        """Ids sent by all queues before each round."""
        return np.where(rounds <= self.full, rounds * self.capacity, self.tail[np.clip(rounds - self.full, 0, len(self.tail) - 1)])

    def round_of(self, place: np.ndarray) -> np.ndarray:
        return np.where(place < self.tail[0], place // self.capacity, self.full + np.searchsorted(self.tail, place, side="right") - 1)

    def clock(self, total: np.ndarray) -> np.ndarray:
        """When, with every queue sending steadily, ``total`` ids have left."""
        return np.interp(total, self.sent, self.times)

    def taken(self, total: np.ndarray) -> np.ndarray:
        """A row for each of ``total``: how many of the first so many ids are each queue's."""
        out = np.clip(np.floor(self.clock(total)[:, None] * self.weights + 0.5).astype(np.int64), 0, self.totals)
        open_rows = np.arange(len(total))
        last = len(self.totals) - 1
        while len(open_rows):
            a = out[open_rows]
            left = total[open_rows] - a.sum(1)
            after = np.where(a < self.totals, (a + 0.5) / self.weights, np.inf)
            before = np.where(a > 0, (a - 0.5) / self.weights, -np.inf)
            up, down = after.argmin(1), last - before[:, ::-1].argmax(1)
            at = np.arange(len(a))
            late, early = after[at, up], before[at, down]
            swap = (left == 0) & ((early > late) | ((early == late) & (down > up)))
            more, fewer = (left > 0) | swap, (left < 0) | swap
            out[open_rows[more], up[more]] += 1
            out[open_rows[fewer], down[fewer]] -= 1
            open_rows = open_rows[more | fewer]
        return out

    def deficits(self, rounds: np.ndarray) -> np.ndarray:
        """What each queue carries into each round: its due so far less what it has sent."""
        total = self.begins(rounds)
        return np.minimum(self.clock(total)[:, None] * self.weights, self.totals) - self.taken(total)

    def near(self, queue: np.ndarray, place: np.ndarray) -> np.ndarray:
        """About the round in which each queue sends its id at ``place``."""
        time = (place + 0.5) / self.weights[queue]
        rows = [np.minimum(self.totals, time[k : k + 1024, None] * self.weights).sum(1) for k in range(0, len(time), 1024)]
        total = np.concatenate(rows) if rows else np.zeros(0)
        return self.round_of(np.clip(total, 0, max(0, int(self.totals.sum()) - 1)).astype(np.int64))

    def pieces(self, queue: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """Runs of a queue's ids cut at the ends of rounds: (which run, start in it, length, round, offset), in order."""
        span = np.maximum(1, (self.weights / self.weights.sum() * ROUNDS * self.capacity).astype(np.int64))[queue]
        parts = -(-length // span)
        run = np.repeat(np.arange(len(queue)), parts)
        start = (np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)) * span[run]
        size = np.minimum(span[run], length[run] - start)
        q, at = queue[run], begin[run] + start
        # as many queues as there are may be a whole id early or late, which moves a place by so many rounds at most
        slack = 1 + -(-len(self.totals) // self.capacity)
        low = np.maximum(0, np.minimum(self.near(q, at), self.full) - slack)
        high = self.near(q, at + size - 1) + slack
        high = np.where(high >= self.full, self.rounds, high)
        order = np.argsort(low, kind="stable")
        group = np.cumsum((high - low + 1)[order]) // (4 * ROUNDS)
        found = [self._cut(q, at, size, low, high, order[group == g]) for g in np.unique(group)]
        which, first, n, rounds, offset = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (zip(*found, strict=True) if found else [[]] * 5))
        first = first - begin[run[which]] if len(which) else first
        back = np.lexsort((first, run[which])) if len(which) else which.astype(np.int64)
        return run[which][back], first[back], n[back], rounds[back], offset[back]

    def _cut(self, queue, at, size, low, high, members) -> tuple[np.ndarray, ...]:
        covered = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in {(int(low[m]), int(high[m])) for m in members}]))
        taken = self.taken(self.begins(covered))
        ahead = np.zeros_like(taken)  # ids of the queues before it in the round that begins at each row
        ahead[:-1, 1:] = np.cumsum(taken[1:] - taken[:-1], axis=1)[:, :-1]
        found = []
        for q in np.unique(queue[members]):
            mine = members[queue[members] == q]
            ends = taken[:, q]
            first = np.searchsorted(ends, at[mine], side="right") - 1
            last = np.searchsorted(ends, at[mine] + size[mine] - 1, side="right") - 1
            many = last - first + 1
            which = np.repeat(mine, many)
            row = np.repeat(first, many) + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            begin = np.maximum(ends[row], at[which])
            end = np.minimum(ends[row + 1], at[which] + size[which])
            some = end > begin
            found.append(tuple(c[some] for c in (which, begin, end - begin, covered[row], ahead[row, q] + begin - ends[row])))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def document_ids(docs: DataFrame, tokenizer_file: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``(id, _source, _task, _before, doc_tokens, _ids)``: each text's ids and the end id, of two bytes each if they allow it,
    and how many ids of its source come before it in its task."""
    from tokenizers import Tokenizer

    wide = max(Tokenizer.from_file(tokenizer_file).get_vocab_size(), end_id) > 0xFFFF

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(tokenizer_file, not wide)
        so_far: dict[str | None, int] = {}
        for batch in batches:
            sources, texts = batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
            for first, last in sized(texts):
                flat, begins = known.of(texts.slice(first, last - first), end_id)
                counts, before = np.diff(begins), []
                for source, n in zip(sources[first:last], counts.tolist(), strict=True):
                    before.append(so_far.get(source, 0))
                    so_far[source] = before[-1] + n
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), last - first, [None, pa.py_buffer(begins * flat.itemsize), pa.py_buffer(flat)]).cast(pa.binary())
                kept = [batch.column(k).slice(first, last - first) for k in (0, 1, 3)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(before, pa.int64()), pa.array(counts), ids], [id_col, "_source", "_task", "_before", "doc_tokens", "_ids"])

    texts = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(source_col).cast("string").alias("_source"), F.col(text_col).cast("string").alias("_text"), F.spark_partition_id().alias("_task"))
    return texts.mapInArrow(run, f"`{id_col}` long, _source string, _task int, _before long, doc_tokens long, _ids binary")


def _queues(sums: DataFrame, targets: dict[str | None, float] | None) -> tuple[DataFrame, list[int], list[float]]:
    """``(_source, _queue)`` of the sources with a queue of their own, and every queue's ids and weight."""
    totals = sums.groupBy("_source").agg(F.sum("_n").alias("_n"))
    every, of_all = totals.agg(F.count("*"), F.sum("_n")).first()
    own = totals.orderBy(F.col("_n").desc(), F.col("_source")).limit(QUEUES if every <= QUEUES else QUEUES - 1).collect()
    sizes, weights = [r["_n"] for r in own], []
    for r in own:
        share = (targets or {}).get(r["_source"], r["_n"] / of_all)
        if not share > 0:
            raise ValueError(f"the target of source {r['_source']!r} is not positive")
        weights.append(share)
    if every > QUEUES:
        sizes.append(of_all - sum(sizes))
        weights.append(sizes[-1] / of_all)
    if not targets:
        weights = [float(n) for n in sizes]
    return sums.sparkSession.createDataFrame([(r["_source"], k) for k, r in enumerate(own)], "_source string, _queue int"), sizes, weights


def _layout(schedule: Schedule, id_col: str):
    """Cuts the ids of each document as the schedule says."""

    def laid_out(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        queue, begin, length = (column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("_queue", "_begin", "doc_tokens"))
        ids = column("_ids").cast(pa.large_binary())
        ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
        data = np.frombuffer(ids.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        flat = data.view("<u2" if len(data) == 2 * length.sum() else "<u4").astype("<u4")
        which, start, n, rounds, offset = schedule.pieces(queue, begin, length)
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(4 * n)]).astype(np.int64)), pa.py_buffer(flat)])
        rows = pa.array(which)
        arrays = [column(id_col).take(rows), pa.array(start), pa.array(n), pa.array(length[which]), pa.array(rounds), pa.array(offset), column("_source").take(rows), parts.cast(pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, [id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "source", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.cumsum(batch.column(batch.schema.get_field_index("doc_tokens")).to_numpy(zero_copy_only=False))
            first = 0
            while first < len(batch):  # so many ids at once, or one document
                last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + SLICE_IDS, side="right")))
                yield laid_out(batch.slice(first, last - first))
                first = last

    return run


def pack_mixture(
    docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 1, targets: dict[str | None, float] | None = None,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """``(id, start, length, doc_tokens, sequence_id, offset, source, ids)`` for every piece of every document.

    ``targets`` are the shares that sources should have, as far as their ids reach; one that it does not name has its own share
    of all ids.  ``ids`` are little-endian unsigned 32-bit values."""
    if capacity & (capacity - 1):
        raise ValueError("the capacity is a power of two")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    documents = written(document_ids(docs, tokenizer_file, end_id, id_col, text_col, source_col))
    sums = written(documents.groupBy("_task", "_source").agg(F.sum("doc_tokens").alias("_n")))
    names, sizes, weights = _queues(sums, targets)
    queued = sums.join(F.broadcast(names.withColumnRenamed("_source", "_name")), F.col("_source").eqNullSafe(F.col("_name")), "left")  # QUEUES rows at most
    queued = queued.select("_task", "_source", "_n", F.coalesce("_queue", F.lit(QUEUES - 1)).alias("_queue"), F.floor(F.col("_task") / BLOCK).alias("_block"))
    inside = Window.partitionBy("_queue", "_block").orderBy("_task", "_source").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("_queue").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = queued.groupBy("_queue", "_block").agg(F.sum("_n").alias("_sum")).select("_queue", "_block", F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_far"))
    begins = queued.withColumn("_near", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(blocks, ["_queue", "_block"])
    begins = written(begins.select(F.col("_task").alias("_t"), F.col("_source").alias("_s"), "_queue", (F.col("_near") + F.col("_far")).alias("_base")))
    discard(sums)
    found = F.broadcast(begins) if begins.count() <= BROADCAST_ROWS else begins.hint("shuffle_hash")
    placed = documents.join(found, (F.col("_task") == F.col("_t")) & F.col("_source").eqNullSafe(F.col("_s")))
    placed = placed.select(id_col, "_source", "_queue", (F.col("_base") + F.col("_before")).alias("_begin"), "doc_tokens", "_ids")
    schema = f"`{id_col}` long, start long, length long, doc_tokens long, sequence_id long, offset long, source string, ids binary"
    return placed.mapInArrow(_layout(Schedule(sizes, weights, capacity), id_col), schema)
