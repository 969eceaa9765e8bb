"""Sequences of one key worked on by many tasks: running sums, sliding windows and state machines in blocks.

Rows are sorted into ranges by key and order, so a key with most of all rows lies in many ranges.  What a range does to a
key is worked out by itself: a sum, a number of rows, or, for a machine of few states, where each state leads and what it
counts on the way.  These compose associatively; there is one such row a range and key, and only they are brought together by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import saved

#: Places of one key that a sliding window takes together.
BLOCK = 10_000


def in_ranges(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``rows`` with ``_range``: sorted by key and order over as many ranges as there are shuffle partitions."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(rows.repartitionByRange(n, key, order).sortWithinPartitions(key, order).withColumn("_range", F.spark_partition_id()))


def _carried(ranged: DataFrame, key: str, value: Column) -> DataFrame:
    """``(key, _range, _carried)`` where a key goes on from earlier ranges: what they sum to.  One row a range at most."""
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return ranged.groupBy(key, "_range").agg(F.sum(value).alias("_sum")).withColumn("_carried", F.sum("_sum").over(earlier)).where("_carried is not null").select(key, "_range", "_carried")


def running(rows: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` up to each row of a key, in ``order``."""
    ranged = in_ranges(rows.withColumn("_value", value.cast("long")), key, order)
    inside = Window.partitionBy(key, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    carried = F.broadcast(_carried(ranged, key, F.col("_value")))  # as many rows as ranges, whatever the input
    out = ranged.withColumn("_inside", F.sum("_value").over(inside)).join(carried, [key, "_range"], "left")
    return out.withColumn(name, F.col("_inside") + F.coalesce("_carried", F.lit(0))).drop("_value", "_inside", "_carried", "_range")


def sliding(rows: DataFrame, key: str, order: str, size: int) -> tuple[DataFrame, Column]:
    """``rows`` dealt into blocks of each key with the ``size`` - 1 rows before each block as context, and the condition that
    holds for rows of the block itself; windows over (key, ``_block``) of ``size`` rows are then right for these."""
    placed = running(rows, key, order, F.lit(1), "_place")
    at = F.col("_place") - 1
    own = F.floor(at / BLOCK).cast("long")
    both = F.when(at % BLOCK >= BLOCK - (size - 1), F.array(own, own + 1)).otherwise(F.array(own))
    return placed.withColumn("_own", own).withColumn("_block", F.explode(both)), F.col("_own") == F.col("_block")


def composed(to: np.ndarray, applied: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The map of a sequence of maps: a row each of where states lead and what they count, combined pairwise."""
    while len(to) > 1:
        if len(to) % 2:
            to = np.vstack([to, np.arange(to.shape[1])[None]])
            applied = np.vstack([applied, np.zeros((1, applied.shape[1]), applied.dtype)])
        first, then = to[0::2], to[1::2]
        applied = applied[0::2] + np.take_along_axis(applied[1::2], first, 1)
        to = np.take_along_axis(then, first, 1)
    return to, applied


def machine(rows: DataFrame, key: str, order: str, symbol: str, states: list[str], transitions: dict[str, dict[str, str]], start: str) -> DataFrame:
    """``(key, status, applied, illegal)``: where each key's symbols lead from ``start``, in order.

    A symbol without a transition from the state leaves it as it is and is counted as illegal.  Every range gives a map over
    ``states`` for each key in it; a key's maps are applied in order, one a range."""
    number = {s: k for k, s in enumerate(states)}
    table = {e: np.array([number.get(t.get(s, s)) for s in states]) for e, t in transitions.items()}
    legal = {e: np.array([int(s in t) for s in states]) for e, t in transitions.items()}
    stay, none = np.arange(len(states)), np.zeros(len(states), dtype=np.int64)
    kind = rows.schema[key].dataType.simpleString()

    def frame(found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({key: [f[0] for f in found], "_range": [f[1] for f in found], "n": [f[2] for f in found], "to": [f[3][0].tolist() for f in found], "applied": [f[4][0].tolist() for f in found]})

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            out = []
            names = batch[key].to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, int)
            codes, kinds = pd.factorize(batch[symbol])  # -1 where there is none
            to_of = np.array([*[table.get(k, stay) for k in kinds], stay])
            counts_of = np.array([*[legal.get(k, none) for k in kinds], none])
            for a, b in zip(edges, [*edges[1:], len(names)]):
                to, applied = composed(to_of[codes[a:b]], counts_of[codes[a:b]])
                if held is not None and held[0] == names[a]:
                    held = (names[a], held[1], held[2] + int(b - a), *composed(np.vstack([held[3], to]), np.vstack([held[4], applied])))
                    continue
                if held is not None:
                    out.append(held)
                held = (names[a], int(batch["_range"].iloc[0]), int(b - a), to, applied)
            if out:
                yield frame(out)
        if held is not None:
            yield frame([held])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.where(F.col(key).isNotNull()).select(key, order, symbol).repartitionByRange(n, key, order).sortWithinPartitions(key, order).select(key, symbol, F.spark_partition_id().alias("_range"))
    mapped = ranged.mapInPandas(maps, f"{key} {kind}, _range int, n long, to array<long>, applied array<long>")
    total = mapped.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_range", "to", "applied", "n"))).alias("_maps"))  # one a range at most
    begin = F.struct(F.lit(number[start]).cast("long").alias("s"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("n"))
    at = lambda array, k: F.element_at(array, (k + 1).cast("int"))
    end = F.aggregate("_maps", begin, lambda acc, x: F.struct(at(x["to"], acc["s"]).alias("s"), (acc["a"] + at(x["applied"], acc["s"])).alias("a"), (acc["n"] + x["n"]).alias("n")))
    names = F.array(*map(F.lit, states))
    return total.select(key, end.alias("_end")).select(key, at(names, F.col("_end.s")).alias("status"), F.col("_end.a").alias("applied"), (F.col("_end.n") - F.col("_end.a")).alias("illegal"))


def next_after(rows: DataFrame, key: str, order: str, target: str) -> DataFrame:
    """``rows`` with ``_next``: the least ``target`` that a later row of the key has, in ``order``; null where there is none."""
    ranged = in_ranges(rows, key, order)
    inside = Window.partitionBy(key, "_range").orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    later = Window.partitionBy(key).orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    far = ranged.groupBy(key, "_range").agg(F.min(target).alias("_least")).withColumn("_far", F.min("_least").over(later)).where("_far is not null").select(key, "_range", "_far")
    # a key goes on into a later range at the end of a range only: one row a range at most
    return ranged.withColumn("_near", F.min(target).over(inside)).join(F.broadcast(far), [key, "_range"], "left").withColumn("_next", F.coalesce("_near", "_far")).drop("_near", "_far", "_range")
