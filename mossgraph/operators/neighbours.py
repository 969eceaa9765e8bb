"""Nearest neighbours by cosine, exact: cells around centres, and only those cells that can still hold a nearer row.

Centres are fitted on a bounded sample of rows; every row is put into the cell of its nearest centre, and a cell knows the largest
angle from its centre to a row.  A query first meets the rows of the cells nearest to it; the angle to its k-th best row then
rules out every cell whose nearest possible row is farther, and it meets the rows of the others.  So the sample decides how much is
compared, never what is found.  Rows of a cell are dealt into blocks and queries into chunks, so one task compares a bounded
number of each, as one product of matrices.

A vector of zeros has cosine 0 with all; rows without a vector, or with one of another length, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import saved

#: Rows that centres are fitted on, and the most centres there are.
SAMPLE, CENTRES, ROUNDS = 4096, 256, 8
#: Rows of a block, numbers of the vectors of a chunk's queries, and the cells that a query meets first.
BLOCK, CHUNK, FIRST = 4096, 1 << 22, 3
#: Queries that a task compares with a block at a time, rows that it takes and hands on at a time.
SLICE = 256


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def centres_of(sample: np.ndarray, n: int) -> np.ndarray:
    """Spherical k-means from evenly spaced rows of the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, n).astype(int)]
    for _ in range(ROUNDS):
        own = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), centres)
    return centres


def _matrix(vectors: pd.Series, d: int) -> np.ndarray:
    """Vectors of ``d`` numbers as rows, without a Python number for each."""
    return np.concatenate(vectors.to_numpy()).astype(np.float64, copy=False).reshape(-1, d)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _compared(queries: np.ndarray, a: np.ndarray, ids: np.ndarray, b: np.ndarray, k: int, least: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
    """``(query, id, score)`` of the ``k`` best of ``ids`` with vectors ``b`` for each query, of those that score ``least`` of the query or more, SLICE queries at a time."""
    for start in range(0, len(queries), SLICE):
        own = queries[start : start + SLICE]
        scores = np.round(a[start : start + SLICE] @ b.T, 9)
        scores[own[:, None] == ids[None, :]] = -np.inf
        floor = np.full(len(own), -2.0) if least is None else least[start : start + SLICE]
        if k < len(ids) and (scores >= floor[:, None]).sum(1).max() > k:
            floor = np.maximum(floor, np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k])
        at, which = np.nonzero((scores >= floor[:, None]) & np.isfinite(scores))
        found = scores[at, which]
        order = np.lexsort((ids[which], -found, at))
        at, which, found = at[order], which[order], found[order]
        kept = np.arange(len(at)) - np.searchsorted(at, at) < k
        yield pd.DataFrame({"query": own[at[kept]], "id": ids[which[kept]], "score": found[kept]})


def nearest(queries: DataFrame, rows: DataFrame, k: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """``(query, id, score, place)``: the ``k`` rows of the largest cosine to each query but itself; of equals the smaller ids."""
    q = queries.select(F.col(key).cast("long").alias("query"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    r = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    first = r.select(F.size("v").alias("d")).groupBy("d").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "d").first()
    if first is None:
        return queries.sparkSession.createDataFrame([], "query long, id long, score double, place int")
    d, n = first
    r, q = r.where(F.size("v") == d), q.where(F.size("v") == d)
    sample = r.orderBy(F.xxhash64("id")).limit(SAMPLE).toPandas()  # SAMPLE rows, whatever the input
    fitted = _unit(np.array(sample["v"].tolist(), dtype=np.float64).reshape(-1, d))
    centres = centres_of(fitted, max(1, min(CENTRES, int(n**0.5), len(fitted))))

    def placed(batches):
        for batch in batches:
            if not len(batch):
                continue
            v = _unit(_matrix(batch["v"], d))
            cosines = v @ centres.T
            own = cosines.argmax(1)
            yield pd.DataFrame({"id": batch["id"], "v": list(v), "cell": own, "angle": _angle(cosines[np.arange(len(own)), own])})

    cells = saved(r.mapInPandas(placed, "id long, v array<double>, cell int, angle double"))
    stats = cells.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()  # CENTRES rows at most
    radius = np.full(len(centres), -1.0)
    blocks = {}
    for s in stats:
        radius[s["cell"]], blocks[s["cell"]] = s["radius"], -(-s["n"] // BLOCK)
    sizes = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair])
    dealt = cells.withColumn("block", F.pmod(F.xxhash64("id"), sizes[F.col("cell")]).cast("int"))

    def cells_for(batches, bounded: bool):
        """The cells that each query is to meet: the nearest ones, or, with a bound, all others that may hold a nearer row."""
        for batch in batches:
            if not len(batch):
                continue
            v = _unit(_matrix(batch["v"], d))
            angles = _angle(v @ centres.T)
            angles[:, radius < 0] = np.inf
            order = angles.argsort(1, kind="stable")[:, :FIRST]
            near = np.zeros(angles.shape, dtype=bool)
            np.put_along_axis(near, order, True, 1)
            near &= np.isfinite(angles)
            if bounded:
                limit = _angle(batch["bound"].to_numpy())[:, None] + 1e-9
                zero = ~v.any(1)[:, None]
                wanted = ~near & np.isfinite(angles) & ((angles - radius <= limit) | zero)
            else:
                wanted = near
            at, cell = np.nonzero(wanted)
            if not len(at):
                continue
            ids, vectors, least = (batch[c].to_numpy() for c in ("query", "v", "bound"))
            for start in range(0, len(at), SLICE * FIRST):  # a query may meet all cells, each time with its vector
                part = at[start : start + SLICE * FIRST]
                yield pd.DataFrame({"query": ids[part], "v": vectors[part], "least": least[part], "cell": cell[start : start + SLICE * FIRST].astype(np.int32)})

    def best(asked: DataFrame) -> DataFrame:
        spread = asked.withColumns({"chunk": F.pmod(F.xxhash64("query"), F.lit(chunks)).cast("int"), "block": F.explode(F.sequence(F.lit(0), sizes[F.col("cell")] - 1))})
        held = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

        def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"query": [], "id": [], "score": []}).astype({"query": "int64", "id": "int64", "score": "float64"})
            a, b = _unit(_matrix(left["v"], d)), _matrix(right["v"], d)
            return pd.concat(_compared(left["query"].to_numpy(), a, right["id"].to_numpy(), b, k, left["least"].to_numpy()), ignore_index=True)

        by = ["cell", "block", "chunk"]
        return spread.groupBy(*by).cogroup(held.groupBy(*by)).applyInPandas(compare, "query long, id long, score double")

    chunks = max(1, -(-q.count() * d // CHUNK))
    out = "query long, v array<double>, least double, cell int"
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    top = saved(best(q.withColumn("bound", F.lit(-2.0)).mapInPandas(lambda b: cells_for(b, False), out)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k))
    bounds = top.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(-1.0)).alias("bound"))
    more = q.join(bounds, "query", "left").withColumn("bound", F.coalesce("bound", F.lit(-1.0)))
    rest = best(more.mapInPandas(lambda b: cells_for(b, True), out))
    return top.drop("place").union(rest).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
