"""Exact top-k search by inner product: ball-tree branch and bound in each shard of the candidates.

Candidates are dealt out in shards, queries in blocks, and every block meets every shard. Shards run in waves, each
four times as many as before: one, three, twelve and so on. After a wave every query keeps its k best so far, and their
kth score goes with it into the next, where it cuts off nodes from the start.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agendum.llm import common


class BallTree:
    """Balls over integer vectors: leaves of at most leaf rows, split at the median along the widest direction."""

    def __init__(self, vectors: np.ndarray, leaf: int = 64):
        self.order = np.arange(len(vectors))
        self.lo, self.hi, self.left, self.right, centres, radii = [], [], [], [], [], []
        todo = [(0, len(vectors), -1, False)]
        while todo:
            a, b, parent, second = todo.pop()
            n = len(self.lo)
            if parent >= 0:
                (self.right if second else self.left)[parent] = n
            part = vectors[self.order[a:b]].astype(np.float64)
            centre = part.mean(0)
            far = part - centre
            self.lo.append(a)
            self.hi.append(b)
            self.left.append(-1)
            self.right.append(-1)
            centres.append(centre)
            radii.append(np.sqrt((far * far).sum(1).max(initial=0)))
            if b - a > leaf and radii[-1] > 0:
                along = far[int((far * far).sum(1).argmax())]  # from the centre to the farthest row
                half = (b - a) // 2
                split = np.argpartition(far @ along, half)
                self.order[a:b] = self.order[a:b][split]
                todo += [(a, a + half, n, False), (a + half, b, n, True)]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.vectors = vectors[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No inner product of a query with a row below a node exceeds the node's bound."""
        q = queries.astype(np.float64)
        norms = np.sqrt((q * q).sum(1))[:, None]
        bound = q @ self.centres.T + norms * self.radii
        return bound + 1e-9 * (1 + norms * (np.sqrt((self.centres**2).sum(1)) + self.radii))  # above any rounding


def _exact(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """As doubles where all sums stay below 2**53, so that products are exact either way."""
    top = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, vectors.shape[1])
    return np.float64 if top < 2.0**53 else np.int64


def search(tree: BallTree, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int):
    """Rows (query number, id, score) with all that may be among each query's k best; floor: scores known to be reached k times elsewhere."""
    ids, kind = ids[tree.order], _exact(tree.vectors, queries)
    rows, asked = tree.vectors.astype(kind), queries.astype(kind)
    bounds = tree.bounds(queries)
    for i in range(len(queries)):
        bound, best, kth = bounds[i].tolist(), [], floor[i]  # best: heap of (score, -id), its worst first
        nodes = [(-bound[0], 0)]
        while nodes:
            b, n = heapq.heappop(nodes)
            if -b < kth:
                break  # every node left has a lower bound than the kth score
            if tree.left[n] >= 0:
                for m in (tree.left[n], tree.right[n]):
                    if bound[m] >= kth:
                        heapq.heappush(nodes, (-bound[m], m))
                continue
            a, z = tree.lo[n], tree.hi[n]
            scores = rows[a:z] @ asked[i]
            for j in np.flatnonzero((scores >= kth) & (ids[a:z] != own[i])).tolist():
                item = (int(scores[j]), -int(ids[a + j]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                kth = max(kth, best[0][0])
        for score, minus in best:
            yield i, -minus, score


def scaled(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long; null if the vector or a component is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    sound = vector.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(sound, F.transform(x, lambda v: F.floor(v * F.lit(scale)).cast("long")))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "vector", shard_rows: int = 8192, block_rows: int = 4096) -> DataFrame:
    """Each query's k candidates of highest inner product: query_id, rank (from 1), vec_id, score; ties to the smaller id.

    Vectors are arrays of long; rows with a null key or vector take no part. A query meets all candidates of its length
    but those with its own key; it gets fewer rows if there are fewer. Repeated candidates count each; a query repeated
    with the same vector counts once. Other columns take no part; empty tables give an empty result. Keys are integers.
    A task holds shard_rows candidates and block_rows queries.
    """
    spark = candidates.sparkSession
    common.ship(spark)
    shape = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter("id is not null and v is not null").withColumn("size", F.size("v"))
    c, q = shape(candidates), shape(queries).distinct().withColumn("same", F.xxhash64("v"))  # tells queries of one id apart
    shards, blocks = max(1, -(-c.count() // shard_rows)), max(1, -(-q.count() // block_rows))
    c = c.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    q = q.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    names = ["query_id", "same", "vec_id", "score"]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame([], columns=names, dtype="int64")
        tree = BallTree(np.stack(left["v"].to_numpy()))
        asked = np.stack(right["v"].to_numpy())
        low = right["floor"].fillna(-np.inf).to_numpy(np.float64)
        own, same = right["id"].to_numpy(), right["same"].to_numpy()
        rows = [(own[i], same[i], j, s) for i, j, s in search(tree, left["id"].to_numpy(), asked, own, low, k)]
        return pd.DataFrame(rows, columns=names, dtype="int64")

    def wave(c: DataFrame, q: DataFrame, first: int, last: int) -> DataFrame:
        spread = q.withColumn("shard", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))
        keys = ["size", "shard", "block"]
        copies = c.filter(F.col("shard").between(first, last)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return copies.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(meet, "query_id long, same long, vec_id long, score long")

    order = Window.partitionBy("query_id", "same").orderBy(F.desc("score"), "vec_id")
    best, first, last = None, 0, 0
    with common.scope():
        while first < shards:
            if best is None:
                asked = q.withColumn("floor", F.lit(None).cast("double"))
            else:
                kth = best.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), "same", F.col("score").cast("double").alias("floor"))
                asked = q.join(kth, ["id", "same"], "left")
            found = wave(c, asked, first, last)
            found = found if best is None else found.unionByName(best.drop("rank"))
            best = common.stored(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "best")
            first, last = last + 1, min(shards - 1, 4 * last + 3)
        common.keep(best)
    return best.select("query_id", "rank", "vec_id", "score")
