"""The trie of conversation prefixes, with what sharing a prefix saves, rolled up by pointer jumping.

A node is a distinct sequence of first turns and is keyed by a digest; each has an edge to the digest of the sequence without its
last turn.  The digest of a prefix is chained over blocks of ``BLOCK`` turns and, for longer conversations, over whole blocks by
doubling.  Leaf counts and savings go to all ancestors in logarithmically many rounds: in round k every node hands what it has
gathered to the ancestor 2**k above it, summed before it is shuffled, and takes over that ancestor's pointer, 2**k above again.  A
node deeper than 2**k takes part in round k, so the rounds shrink quickly.

Turns are ordered by ``turn``, nulls first, and where equal by a digest of role and text, so repeated rows are turns that follow each
other.  Null roles and texts are empty.  A row without a conversation id belongs to no conversation and is left out.  Very long
texts are only hashed and counted.  A conversation or a node may have any share of all rows: turns are placed by sorted
ranges, pointers of hot nodes are dealt out, and ids of members reach the task that hashes them as blocks of text.  Other
columns, whatever their names, are ignored.  An empty table gives no rows, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, hot_join, parallelism, written

#: Turns whose digests one task chains; ids of members in one row of text.
BLOCK, MEMBERS = 256, 4096
WIDTH = 16
ROOT = bytes(WIDTH)
WORD = r"[^\x20\x09-\x0D]+"


def _digest(content: Column) -> Column:
    return F.substring(F.unhex(F.sha2(content.cast("binary"), 256)), 1, WIDTH)


def placed_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, place, turn_digest, words)``: every turn with its place, from 0, in its conversation.

    Sorted into ranges, numbered within each, and moved on by what earlier ranges have of the same conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    own = _digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("_turn"), own.alias("turn_digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("_row"),
    )
    rows = written(rows)  # read twice: for the ranges and for the rows
    order = [F.col("conv"), F.col("_turn").asc_nulls_first(), F.col("turn_digest"), F.col("_row")]
    ranged = rows.repartitionByRange(parallelism(turns.sparkSession), *order).sortWithinPartitions(*order).select("conv", "turn_digest", "words", F.spark_partition_id().alias("_range"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, n = None, 0
        for batch in batches:
            places = []
            for conv in batch.column(0).to_pylist():
                n = n + 1 if conv == before else 0
                before = conv
                places.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], ["conv", "turn_digest", "words", "_range", "_near"])

    near = written(ranged.mapInArrow(number, "conv long, turn_digest binary, words long, _range int, _near long"))
    discard(rows)
    earlier = Window.partitionBy("conv").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    over = near.groupBy("_range", "conv").agg(F.count("*").alias("n")).withColumn("_far", F.sum("n").over(earlier)).where("_far is not null").select("_range", "conv", "_far")
    # a conversation goes on from an earlier range at the beginning of a range only: one row a range at most
    return near.join(F.broadcast(over), ["_range", "conv"], "left").select("conv", (F.col("_near") + F.coalesce("_far", F.lit(0))).alias("place"), "turn_digest", "words")


def rebuilt(places: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first h turns of the first of their group: ``(conv, place, turn_digest, words)`` and ``(conv, n)``.

    h is the unsigned crc32 of the decimal id modulo ``heads``; a conversation's own turns after its first h follow."""
    places = written(places)
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("long")
    sizes = written(places.groupBy("conv").agg(F.count("*").alias("n")))
    base = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    plan = sizes.select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % group).alias("base")).join(base, "base", "left")
    plan = written(plan.select("conv", "n", "h", "base", F.least("h", F.coalesce("base_n", F.lit(0))).alias("head")))
    lengths = plan.select("conv", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))
    first = places.where(F.col("place") < heads - 1).withColumnRenamed("conv", "base")  # a group has so many ids at most
    taken = plan.where("head > 0").select("conv", "base", "head").join(first, "base").where("place < head").select("conv", "place", "turn_digest", "words")
    own = hot_join(places, plan.select("conv", "h", "head", "n"), ["conv"], "n", F.col("place")).where("place >= h")
    own = own.select("conv", (F.col("place") - F.col("h") + F.col("head")).alias("place"), "turn_digest", "words")
    return written(taken.union(own)), written(lengths)


def _combined(before: Column, after: Column) -> Column:
    return _digest(F.concat(before, after))


def prefixes(places: DataFrame) -> DataFrame:
    """``(conv, depth, node, parent, words)``: for every turn the digest of all turns up to it, and of those before it."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, ROOT
        for batch in batches:
            found, former = [], []
            for conv, block, turn in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if (conv, block) != key:
                    key, digest = (conv, block), ROOT
                former.append(digest)
                digest = hashlib.sha256(digest + turn).digest()[:WIDTH]
                found.append(digest)
            arrays = [*(batch.column(k) for k in (0, 1, 2, 4)), pa.array(found, pa.binary()), pa.array(former, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["conv", "block", "place", "words", "node", "parent"])

    rows = places.select("conv", F.floor(F.col("place") / BLOCK).alias("block"), "place", "turn_digest", "words")
    rows = rows.repartition(parallelism(places.sparkSession), "conv", "block").sortWithinPartitions("conv", "block", "place")
    chained = written(rows.mapInArrow(chain, "conv long, block long, place long, words long, node binary, parent binary"))
    blocks = (chained.agg(F.max("block")).first()[0] or 0) + 1
    ended = chained.where(F.col("place") % BLOCK == BLOCK - 1).select("conv", "block", F.col("node").alias("digest"))
    step = 1
    while step < blocks - 1:  # digests of all blocks up to each
        further = ended.select("conv", (F.col("block") + step).alias("block"), F.col("digest").alias("before"))
        joined = ended.join(further, ["conv", "block"], "left")
        ended = written(joined.select("conv", "block", F.when(F.col("before").isNull(), F.col("digest")).otherwise(_combined(F.col("before"), F.col("digest"))).alias("digest")))
        step *= 2
    if blocks > 1:
        front = ended.select("conv", (F.col("block") + 1).alias("block"), F.col("digest").alias("before"))
        at = lambda own: F.when(F.col("before").isNull(), F.col(own)).when(F.col(own) == F.lit(ROOT), F.col("before")).otherwise(_combined(F.col("before"), F.col(own)))
        # the last turn of a block has the digest of all blocks up to it, which is what the next block's first turn has as parent
        last = ended.select("conv", "block", ((F.col("block") + 1) * BLOCK - 1).alias("place"), F.col("digest").alias("whole"))
        joined = chained.join(front, ["conv", "block"], "left").join(last, ["conv", "block", "place"], "left")
        chained = joined.select("conv", "block", "place", "words", F.coalesce(F.col("whole"), at("node")).alias("node"), at("parent").alias("parent"))
    return chained.select("conv", (F.col("place") + 1).alias("depth"), "node", "parent", "words")


def _rolled_up(nodes: DataFrame) -> DataFrame:
    """``nodes(node, parent, depth, leaves, saved)`` -> ``(node, n_leaves, saved_tokens)`` summed over subtrees."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    handed = nodes.select("node", "leaves", "saved")
    state = nodes.where("depth > 0").select("node", "depth", F.col("parent").alias("up"), "leaves", "saved")
    step, old = 1, None
    while step <= deepest:  # ``state`` has the nodes of this depth or more, ``up`` is so far above them
        sums = written(state.groupBy(F.col("up").alias("node")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count("*").alias("n")))
        handed = handed.union(sums.select("node", "leaves", "saved"))
        if 2 * step <= deepest:
            further = written(state.select(F.col("node").alias("up"), F.col("up").alias("next")).join(sums.select(F.col("node").alias("up"), "n"), "up"))
            more = sums.select("node", F.col("leaves").alias("_l"), F.col("saved").alias("_s"))
            left = state.where(F.col("depth") >= 2 * step).join(more, "node", "left")
            left = left.select("node", "depth", "up", (F.col("leaves") + F.coalesce("_l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("_s", F.lit(0))).alias("saved"))
            state = written(hot_join(left, further, ["up"], "n", F.col("node")).select("node", "depth", F.col("next").alias("up"), "leaves", "saved"))
            discard(further, old)
            old = state
        step *= 2
    discard(old)
    return handed.groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def member_digests(ends: DataFrame) -> DataFrame:
    """``ends(node, conv)`` -> ``(node, ends_sha256)`` of the ids in numerical order, joined by commas.

    The order comes from sorted ranges, and only blocks of joined ids are brought together for a node."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def closed() -> tuple:
            return key, ids[0], ",".join(map(str, ids))

        for batch in batches:
            done = []
            for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (node != key or len(ids) == MEMBERS):
                    done.append(closed())
                    ids = []
                key = node
                ids.append(conv)
            yield _batch(done, ["node", "first", "ids"], (pa.binary(), pa.int64(), pa.string()))
        if ids:
            yield _batch([closed()], ["node", "first", "ids"], (pa.binary(), pa.int64(), pa.string()))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if node != key:
                    if state:
                        done.append((key, state.hexdigest()))
                    key, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _batch(done, ["node", "ends_sha256"], (pa.binary(), pa.string()))
        if state:
            yield _batch([(key, state.hexdigest())], ["node", "ends_sha256"], (pa.binary(), pa.string()))

    n = parallelism(ends.sparkSession)
    listed = ends.select("node", "conv").repartitionByRange(n, "node", "conv").sortWithinPartitions("node", "conv").mapInArrow(blocks, "node binary, first long, ids string")
    return listed.repartition(n, "node").sortWithinPartitions("node", "first").mapInArrow(digests, "node binary, ends_sha256 string")


def _batch(rows: list[tuple], names: list[str], kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def prefix_trie(places: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row a node: ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, n_words)``.

    ``places(conv, place, turn_digest, words)`` are the turns, ``lengths(conv, n)`` all conversations, those without turns
    included.  A node is named by its smallest member and its depth."""
    rows = written(prefixes(places))
    lengths = written(lengths)
    root = lengths.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("n_words"))
    found = rows.groupBy("node").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("n_words"))
    nodes = written(found.unionByName(root))
    children = written(nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children")))
    nodes = written(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    totals = _rolled_up(nodes.select("node", "parent", "depth", leaf.alias("leaves"), ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved")))
    parents = written(nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children"))
    edges = hot_join(nodes.where("parent is not null").select("node", "parent"), parents, ["parent"], "n_children", F.col("node")).drop("parent")
    at_end = lengths.where("n > 0").select("conv", F.col("n").alias("depth")).join(rows.select("conv", "depth", "node"), ["conv", "depth"]).select("node", "conv")
    ends = written(at_end.union(lengths.where("n = 0").select(F.lit(ROOT).alias("node"), "conv")))
    out = nodes.join(totals, "node").join(edges, "node", "left").join(member_digests(ends), "node", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "n_words",
    )
