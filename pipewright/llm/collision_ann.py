"""Approximate nearest neighbours by collision counting (operator 7).

Vectors are dealt into blocks of one length each. A block is projected on ``PROJECTIONS`` single random
directions, and every projection is kept as a sorted array. Around a query's own projections windows grow by
virtual rehashing: the radius is multiplied, the arrays stay. A projected difference is normal with the distance as
its deviation, so a vector within the radius falls into one array's window with probability
p = P(|N(0, 1)| <= ``WIDTH``) at least. Vectors whose collisions reach the threshold, the most arrays that such a vector
misses with probability ``MISS`` at most, are verified by their exact distance; the others never are. A query
stops in a block once it has k verified vectors within the radius.

Every block goes to one task, which indexes it once and then reads the queries as a stream: the vectors are moved once,
and a task holds one block and a few queries whatever the tables' sizes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch, table

K = 10
PROJECTIONS = 160
WIDTH = 1.25  # half a window, in radii
MISS = 0.25  # of the vectors exactly at the radius; nearer ones are missed less
GROWTH, FAR_GROWTH, NEAR_ROUNDS = 1.06, 1.5, 24  # steps of the radius; queries far from all others take the larger ones
BLOCK = 16384  # vectors of one index at most
NUMBERS = 1 << 21  # components of one index's vectors at most
QUERIES = 64  # searched side by side
SAMPLE = 64  # vectors of a block whose k-th distances give the first radius


def threshold(arrays: int, width: float = WIDTH, miss: float = MISS) -> int:
    """The largest number of arrays that a vector at the radius reaches with probability 1 - ``miss`` at least."""
    p = math.erf(width / math.sqrt(2))
    below = 0.0
    for x in range(arrays + 1):
        below += math.exp(math.lgamma(arrays + 1) - math.lgamma(x + 1) - math.lgamma(arrays - x + 1) + x * math.log(p) + (arrays - x) * math.log(1 - p))
        if below > miss:
            return max(1, x)
    return arrays


class CollisionIndex:
    """Sorted projections of a block of vectors."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, k: int = K, projections: int = PROJECTIONS, seed: int = 11):
        self.vectors, self.ids, self.k = vectors, ids, k
        self.axes = np.random.default_rng(seed).standard_normal((projections, vectors.shape[1]))
        on = np.ascontiguousarray((vectors @ self.axes.T).T)
        self.order = list(np.argsort(on, axis=1, kind="stable"))
        self.sorted = [row[order] for row, order in zip(on, self.order, strict=True)]
        self.need = threshold(projections)
        some = vectors[np.random.default_rng(seed).permutation(len(vectors))[:SAMPLE]]
        kth = [np.partition(self._distances(x, vectors), min(k, len(vectors) - 1))[min(k, len(vectors) - 1)] for x in some]
        apart = np.array([x for x in kth if x > 0] or [max(1e-9, float(np.abs(vectors).max(initial=0)))])
        self.radius = float(np.quantile(apart, 0.05))

    @staticmethod
    def _distances(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        return np.sqrt(((vectors - query) ** 2).sum(axis=1))

    def search(self, queries: np.ndarray, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """For each query (positions, distances, number verified) of the k nearest found; ties to smaller ids, own ids left out."""
        n, m = len(self.vectors), len(self.axes)
        at = queries @ self.axes.T
        low = np.stack([np.searchsorted(s, at[:, i]) for i, s in enumerate(self.sorted)], axis=1)
        high, count = low.copy(), np.zeros((len(queries), n), np.int32)
        done = self.ids[None, :] == own[:, None]
        best = [(np.zeros(0, np.int64), np.zeros(0), 0)] * len(queries)
        active, radius, rounds = list(range(len(queries))), self.radius, 0
        while active:
            a, b = low[active], high[active]
            for i, s in enumerate(self.sorted):
                a[:, i] = np.minimum(a[:, i], np.searchsorted(s, at[active, i] - WIDTH * radius))
                b[:, i] = np.maximum(b[:, i], np.searchsorted(s, at[active, i] + WIDTH * radius, side="right"))
            going = []
            for j, q in enumerate(active):
                fresh = [o[x:y] for o, x, y in zip(self.order, a[j].tolist(), low[q].tolist(), strict=True) if x < y]
                fresh += [o[x:y] for o, x, y in zip(self.order, high[q].tolist(), b[j].tolist(), strict=True) if x < y]
                low[q], high[q] = a[j], b[j]
                if fresh:
                    count[q] += np.bincount(np.concatenate(fresh), minlength=n).astype(np.int32)
                found = np.flatnonzero((count[q] >= self.need) & ~done[q])
                positions, distances, verified = best[q]
                if len(found):
                    done[q, found] = True
                    positions = np.concatenate([positions, found])
                    distances = np.concatenate([distances, self._distances(queries[q], self.vectors[found])])
                    first = np.lexsort((self.ids[positions], distances))[: self.k]
                    best[q] = positions[first], distances[first], verified + len(found)
                near = len(best[q][1]) == self.k and best[q][1][-1] <= radius
                if not near and ((low[q] > 0).any() or (high[q] < n).any()):
                    going.append(q)
            active = going
            rounds += 1
            radius *= GROWTH if rounds < NEAR_ROUNDS else FAR_GROWTH
        return best


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("v").flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1)


def _search(k: int):
    """Rows come by slot, in each slot the block's vectors before the queries."""

    def runs(batch: pa.RecordBatch) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
        slot, asks = batch.column("slot").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero((np.diff(slot) != 0) | (np.diff(asks) != 0)) + 1).tolist(), batch.num_rows]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            if y > x:
                yield int(slot[x]), bool(asks[x]), batch.slice(x, y - x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, held, ids, index = None, [], [], None
        for batch in batches:
            for here, asks, part in runs(batch):
                if here != slot:
                    slot, held, ids, index = here, [], [], None
                if not asks:
                    held.append(_matrix(part))
                    ids.append(part.column("vec_id").to_numpy())
                    continue
                if index is None:
                    if not held:  # no vectors in this block
                        continue
                    index = CollisionIndex(np.concatenate(held), np.concatenate(ids), k)
                    held = []
                for at in range(0, part.num_rows, QUERIES):
                    few = part.slice(at, QUERIES)
                    own = few.column("vec_id").to_numpy()
                    found = index.search(_matrix(few), own)
                    sizes = [len(x) for x, _, _ in found]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(own, sizes)), pa.array(index.ids[np.concatenate([x for x, _, _ in found])]),
                            pa.array(np.concatenate([d for _, d, _ in found])),
                        ], names=["query_id", "vec_id", "score"],
                    )

    return run


def nearest(vectors: DataFrame, queries, k: int = K, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows by Euclidean distance, nearest first.

    ``vectors`` has vec_id and embedding (other columns are not read); ``queries`` is a condition on them. Vectors that
    are null, zero or hold null or non-finite components take no part, nor do rows without an id, which no result could name.
    Vectors of another length than the query's have no distance to it: each length is searched on its own.
    Ties go to the smaller vec_id; a query's own id is never a result; rows that repeat an id count once for
    queries (the least vector) and each time for results. Fewer than k candidates: all. Every row is indexed. No rows or queries
    give an empty result.
    """
    scratch = Scratch(vectors.sparkSession, "nearest")
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("asked"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = scratch.keep("vectors", rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine).withColumn("size", F.size("v")))
    # blocks of each length, numbered over all lengths
    most = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(NUMBERS) / F.col("size"))))
    kinds = rows.groupBy("size").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / most))
    kinds = kinds.withColumn("first", F.sum("blocks").over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("blocks"))
    kinds = scratch.keep("lengths", kinds.select("size", F.col("blocks").cast("long"), F.col("first").cast("long")))
    slots = kinds.agg(F.sum("blocks")).first()[0] or 1
    # the hash takes in the vector, so that copies under one id spread as well
    dealt = rows.join(kinds, "size").select((F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks"))).alias("slot"), F.lit(False).alias("asks"), "vec_id", "v")
    asked = rows.where("asked").groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("size", F.size("v"))
    asked = asked.join(kinds, "size").select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)).alias("slot"), F.lit(True).alias("asks"), "vec_id", "v")
    streams = dealt.union(asked).repartitionById(int(slots), F.col("slot").cast("int")).sortWithinPartitions("slot", "asks")
    found = streams.mapInArrow(_search(k), "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nearest`` for every vector whose id is divisible by 100; nulls and empty tables as there."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
