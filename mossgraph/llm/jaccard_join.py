"""Exact n-gram Jaccard join with set-relation skipping, and the groups that its links form.

A text's set holds the hashes of its distinct word shingles.  Equal sets are one class and never compared.  Each class
indexes the shingles of its prefix (as many as any linked partner must share one of), rarest first by a fixed-size sketch
of document frequencies; any order of shingles gives the same links, so the sketch may be coarse.

Index lists are skipped by position: a list is cut into blocks by set size, and a set only meets the blocks whose sizes it
can link with.  Answers are derived rather than recomputed: a set is compared with one pivot, the best connected set of the
largest group of its blocks, and if it is highly similar takes over the pivot's group, so pairs within a group need no
comparison.  Rounds go on, with other pivots, while they pay.  At last every pair of a block whose groups still differ is
verified if the prefixes share as many positions as a link requires, which is counted in the join.  So no pair that could
join two groups is left out, while neither copies nor near copies expand into all pairs.

Null and empty texts have an empty set and link with nothing.  Texts with fewer words than a shingle have their whole
sequence as the one member.  A null id keeps its row, with a null group.  Rows that repeat an id are one node: a link of any
of them is a link of that id.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components
from .storage import discard, parallelism, set_aside, small_batches, written
from .words import U, chain, slices, word_hashes

#: Counters of the frequency sketch: one byte each, a logarithm of the count, whatever the input, in so many blocks.
SKETCH = 1 << 24
BLOCKS = 64
#: Entries of index blocks longer than LONG carry the first HEAD of their set's indexed shingles and are worked by pivots,
#: in rounds that go on while one in PAYS of the pairs compared link and one set in FEW is compared.
LONG, HEAD, PAYS, FEW = 8, 48, 5, 1000
#: Buckets of ids, so many whatever the input: texts of other buckets are left out before any shuffle.
BUCKETS = 1 << 20
#: Pairs of one block that one task makes.
PAIRS = 4_000_000


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles."""
    for a, b in slices(texts):
        words, at = word_hashes(texts[a:b])
        rows = words
        for k in range(1, width):
            rows = chain(rows[: len(words) - k], words[k:])
        for begin, end in zip(at[:-1], at[1:], strict=True):
            if end - begin >= width:
                yield np.unique(rows[begin : end - width + 1])
            else:
                whole = words[begin:end][:1]
                for k in range(begin + 1, end):
                    whole = chain(whole, words[k : k + 1])
                yield whole


def _needed(size: int, num: int, den: int) -> int:
    """The least overlap of a set of ``size`` with one of its own size or less than linked: ceil(size * num / den)."""
    return -(-size * num // den)


def frequency_sketch(docs: DataFrame, width: int) -> np.ndarray:
    """Logarithms of the counts of documents by shingle hash, SKETCH bytes."""
    step = SKETCH // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(SKETCH, np.uint16), [], 0

        def add_held() -> None:
            at, n = np.unique(np.concatenate(held) & U(SKETCH - 1), return_counts=True)
            at = at.astype(np.int64)
            total[at] = np.minimum(total[at].astype(np.int64) + n, 65535)

        for batch in batches:
            for found in shingle_sets(batch.column(0).to_pylist(), width):
                held.append(found)
                size += len(found)
                if size > 1 << 19:
                    add_held()
                    held, size = [], 0
        if held:
            add_held()
        for k in range(BLOCKS):
            part = total[k * step : (k + 1) * step]
            if part.any():
                part = part.astype(np.uint8) if part.max() < 256 else part
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.itemsize], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["block", "wide", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, wide, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(zlib.decompress(counts), np.uint8 if wide == 1 else np.uint16)
                total[block] = total.get(block, 0) + part.astype(np.uint64)
        levels = [(k, np.round(8 * np.log2(1.0 + v)).astype(np.uint8).tobytes()) for k, v in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in levels], pa.int32()), pa.array([r[1] for r in levels], pa.binary())], ["block", "levels"])

    counted = docs.select("_text").mapInArrow(count, "block int, wide int, counts binary")
    sums = counted.repartition(min(BLOCKS, parallelism(docs.sparkSession)), "block").mapInArrow(add, "block int, levels binary")
    sketch = np.zeros(SKETCH, np.uint8)
    for block, levels in sums.toLocalIterator():  # BLOCKS rows: SKETCH bytes in all
        sketch[block * step : (block + 1) * step] = np.frombuffer(levels, np.uint8)
    return sketch


def described(docs: DataFrame, width: int, num: int, den: int, sketch: np.ndarray) -> DataFrame:
    """``(_id, n, class, prefix)`` of every text, written; the sketch is on no executor any more."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)  # SKETCH bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for batch in batches:
            sizes, keys, prefixes = [], [], []
            for found in shingle_sets(batch.column(1).to_pylist(), width):
                n = len(found)
                sizes.append(n)
                keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                p = n - _needed(n, num, den) + 1 if n else 0
                prefixes.append(found[np.lexsort((found, level[(found & U(SKETCH - 1)).astype(np.int64)]))[:p]].view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))],
                ["_id", "n", "class", "prefix"],
            )

    out = written(docs.mapInArrow(run, "_id long, n long, class binary, prefix array<long>"))
    shared.destroy()
    return out


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for k, (left, right) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                if not len(x):
                    continue
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                same = int(np.count_nonzero(y[at] == x))
                if den * same >= num * (len(x) + len(y) - same):
                    kept.append(k)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    left = sets.select(F.col("_id").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("_id").alias("b"), F.col("set").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``(_id, set)`` of the texts whose id is in ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.tobytes() for s in shingle_sets(batch.column(1).to_pylist(), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["_id", "set"])

    bucket = F.pmod(F.xxhash64("_id"), F.lit(BUCKETS)).cast("int")
    near = docs.withColumn("_b", bucket).join(F.broadcast(ids.select(bucket.alias("_b")).distinct()), "_b", "left_semi").select("_id", "_text")  # BUCKETS rows at most
    return near.join(ids, "_id", "left_semi").mapInArrow(run, "_id long, set binary")


def _labelled(index: DataFrame, links: DataFrame) -> DataFrame:
    """``index`` with the group of each id so far."""
    labels = connected_components(links)
    return index.join(labels.withColumnRenamed("id", "_id"), "_id", "left").withColumn("group", F.coalesce("component", "_id")).drop("component")


def _indexed(prefixes: DataFrame, num: int, den: int) -> DataFrame:
    """``(_id, n, s, band, block, c, k, w, head, former)``: each set in the blocks of its prefix shingles.

    ``c``: sets in the block, two at least; ``k``: entries of the set in blocks of this number; ``w``: the sum of their
    ``c``; ``head``: the first HEAD of their shingles, for long blocks; ``former``: the shingle before this one."""
    # Index lists of two sets or more, cut into blocks by size: sets that may link share the block of the larger one.
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(den / num) if den > num else 1.0) + F.lit(1e-9)).cast("int")
    entries = prefixes.select("_id", "n", F.explode("prefix").alias("s"))
    lists = entries.groupBy("s").agg(F.count("*").alias("c")).where("c > 1").select("s")
    shared = written(entries.join(lists, "s").withColumn("band", band))
    blocks = shared.select("_id", "n", "s", "band", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("block"))
    long_enough = blocks.groupBy("s", "block").agg(F.count("*").alias("c")).where("c > 1")
    mine = Window.partitionBy("_id", "n", "block")
    sized = blocks.join(long_enough, ["s", "block"]).withColumns({"former": F.lag("s").over(mine.orderBy("s")), "k": F.count("*").over(mine), "w": F.sum("c").over(mine), "_any": F.max("c").over(mine)})
    place = mine.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.when(F.col("_any") > LONG, F.slice(F.array_sort(F.collect_list(F.when(F.col("_any") > LONG, F.col("s"))).over(place)), 1, HEAD))
    headed = sized.withColumn("head", own)
    index = written(headed.select("_id", "n", "s", "band", "block", "c", "k", "w", F.when(F.col("c") > LONG, F.col("head")).alias("head"), "former"))
    discard(shared)
    return index


def link_groups(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id)``: the smallest id that links of similarity ``num / den`` or more lead to."""
    with small_batches(docs.sparkSession, 1000):
        return _link_groups(docs, width, num, den, id_col, text_col)


def _link_groups(docs: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    described_ = described(texts, width, num, den, frequency_sketch(texts, width))
    some = described_.where("n > 0 and _id is not null")
    classes = written(some.groupBy("class", "n").agg(F.min("_id").alias("_id")))
    prefixes = some.groupBy("class", "n").agg(F.min(F.struct("_id", "prefix")).alias("first")).select("n", "first._id", "first.prefix")
    index = _indexed(prefixes, num, den)
    table = written(described_.select("_id", "n", "class"))
    discard(described_)

    # A pair's overlap is ceil(t / (1 + t) * (n + m)) if it links; so many common positions of both prefixes follow from it.
    required = f"cast(ceil({num} * (n + n2) / {num + den}.0 - 1e-9) as int) - cast(ceil({num} * greatest(n, n2) / {den}.0 - 1e-9) as int) + 1"
    n_classes = classes.count()
    links = tried = None
    long_blocks = index.where(F.col("c") > LONG).withColumn("group", F.col("_id"))
    while True:
        # Sets outside the largest group of a long block meet the set of that group that is in the most and longest blocks.
        sizes = long_blocks.groupBy("s", "block", "group").agg(F.count("*").alias("m"), F.max(F.struct("w", (-F.col("_id")).alias("_id"), "n", "k")).alias("pick"))
        largest = sizes.groupBy("s", "block").agg(F.max(F.struct("m", "pick", "group")).alias("top"), F.count("*").alias("groups")).where("groups > 1")
        pivots = largest.select("s", "block", F.col("top.group").alias("main"), (-F.col("top.pick._id")).alias("pivot"), F.col("top.pick.n").alias("n2"), F.col("top.pick.k").alias("k2"))
        met = long_blocks.join(pivots, ["s", "block"]).where(f"group <> main and {den} * least(n, n2) >= {num} * greatest(n, n2) and least(k, k2) >= {required}").groupBy("_id", "pivot").agg(F.count("*").alias("m"))
        met = met.select("_id", "m", F.least("_id", "pivot").alias("a"), F.greatest("_id", "pivot").alias("b"))
        if tried is not None:
            met = met.join(tried, ["a", "b"], "left_anti")
        pairs = written(met.groupBy("_id").agg(F.max(F.struct("m", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))).alias("best")).select((-F.col("best.a")).alias("a"), (-F.col("best.b")).alias("b")).distinct())
        n_pairs = pairs.count()
        if n_pairs * FEW <= n_classes:
            break  # too little to gain: what is left is verified below
        sets = written(_sets_of(texts, pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct(), width))
        found = written(_verified(pairs, sets, num, den))
        discard(sets)
        links = found if links is None else links.union(found)
        tried = pairs if tried is None else tried.union(pairs)
        n_found = found.count()
        if n_found:
            before, long_blocks = long_blocks, written(_labelled(index.where(F.col("c") > LONG), links))
            discard(before)
        if n_found * PAYS < n_pairs:
            break

    discard(long_blocks)
    work = index.withColumn("group", F.col("_id")) if links is None else written(_labelled(index, links))

    # Every pair of a block that could still join two groups and shares as many prefix positions as a link requires.
    open_blocks = work.groupBy("s", "block").agg(F.min("group").alias("g0"), F.max("group").alias("g1")).where("g0 < g1").select("s", "block")
    rest = work.join(open_blocks, ["s", "block"])
    tally = rest.groupBy("s", "block", "group").agg(F.count("*").alias("m"))
    # A block that makes many pairs is dealt over several tasks: each has a part of the sets outside the main group, and all others.
    out_of_it = F.sum("m") - F.max("m")
    parts = F.greatest(F.lit(1), F.least(out_of_it, F.ceil(out_of_it * F.sum("m") / PAIRS))).cast("int")
    main = tally.groupBy("s", "block").agg(F.max(F.struct("m", "group")).alias("top"), parts.alias("parts")).select("s", "block", F.col("top.group").alias("main"), "parts")
    marked = rest.join(main, ["s", "block"]).select("_id", "n", "s", "band", "block", "group", "k", "head", "former", "parts", (F.col("group") == F.col("main")).alias("inner"))
    outer = marked.where("not inner").withColumn("part", F.pmod(F.xxhash64("_id"), F.col("parts")).cast("int"))
    other = marked.select("s", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[F.col(c).alias(f"{c}2") for c in ("_id", "n", "band", "group", "k", "head", "former", "inner")])
    # A pair is taken in the list of the least shingle that both heads hold; without one, where a run of common ones begins.
    # Common positions: those within both heads, and behind them as many at most as either set has left.
    common = "array_intersect(head, head2)"
    at_most = f"CASE WHEN head IS NULL OR head2 IS NULL THEN least(k, k2) ELSE size({common}) + least(greatest(k - {HEAD}, 0) + size(filter(head, x -> x > array_max(head2))), greatest(k2 - {HEAD}, 0) + size(filter(head2, x -> x > array_max(head)))) END"
    pairs = (
        outer.join(other, ["s", "block", "part"])
        .where(f"group <> group2 and (inner2 or _id < _id2) and block = greatest(band, band2) and {den} * least(n, n2) >= {num} * greatest(n, n2)")
        .where(f"least(k, k2) >= {required} AND CASE WHEN coalesce(size({common}), 0) > 0 THEN array_min({common}) = s ELSE NOT (former <=> former2) OR former IS NULL END AND {at_most} >= {required}")
        .select(F.least("_id", "_id2").alias("a"), F.greatest("_id", "_id2").alias("b")).distinct()
    )
    if tried is not None:
        pairs = pairs.join(tried, ["a", "b"], "left_anti")
    pairs = written(pairs)
    discard(work)
    if not pairs.isEmpty():
        sets = written(_sets_of(texts, pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct(), width))
        found = _verified(pairs, sets, num, den)
        links = written(found if links is None else links.union(found))
        discard(sets)
    discard(index, pairs)

    nodes = table.where("n > 0 and _id is not null").join(classes.select("class", "n", F.col("_id").alias("first")), ["class", "n"]).select("_id", "first")
    same = nodes.where("_id <> first").select(F.col("_id").alias("a"), F.col("first").alias("b"))
    if links is None:
        roots = classes.select(F.col("_id").alias("first"), F.col("_id").alias("root")).distinct()
    else:
        roots = connected_components(links).withColumnRenamed("id", "first").withColumnRenamed("component", "root")
    repeated = nodes.distinct().groupBy("_id").count().where("count > 1")
    if not repeated.isEmpty():  # ids with several texts tie their classes together
        edges = same if links is None else same.union(links)
        found = connected_components(edges)
        labels = found.select(F.col("id").alias("_id"), F.col("component").alias("component_id"))
        out = table.join(labels, "_id", "left")
    else:
        keyed = table.join(classes.select("class", "n", F.col("_id").alias("first")), ["class", "n"], "left").join(roots, "first", "left")
        out = keyed.withColumn("component_id", F.coalesce("root", "first"))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with only the row of the smallest id of each group; rows with a null id or an empty set all stay."""
    docs, back = set_aside(docs, {"_gone"})
    groups = link_groups(docs, width, num, den, id_col, text_col).where(f"`{id_col}` <> component_id").select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(groups, docs[id_col] == F.col("_gone"), "left_anti").withColumnsRenamed(back)
