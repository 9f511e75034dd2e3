"""Approximate nearest neighbours by a hash-prefix forest.

The rows are dealt into blocks, and each block holds a forest: for every tree the
long hash strings (signs of random projections) of its rows as one sorted array.
A query descends every tree to its longest matching prefix, which is a range of
the sorted array, and then ascends all trees together, bit by bit from the longest of these,
taking in (and scoring) the rows that a shorter prefix adds.  It stops ascending once it has k
candidates and the chance that all trees missed a row as near as its k-th best,
(1 - p ** depth) ** trees, is at most MISS; p is the chance that one bit agrees.
At depth 0 all rows are candidates, so nothing is capped: a query without near
rows ascends further.  The blocks' best rows are merged to each query's k nearest.

Nearness is the cosine in double precision on the original vectors; ties go to
the smaller vec_id.  A query is no candidate of its own.  Rows whose vector is
null, zero or holds null or non-finite components, and rows without a vec_id, take
no part; vectors of another length than the query's are no candidates of it.
Repeated rows are candidates each.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import small_batches

TREES, BITS = 12, 32
MISS = 0.05
#: From one in so many of a block's rows on, the rows that a depth adds are scored as one product of matrices.
MANY = 16
#: Vectors of gathered rows that are held at once.
SCORED_AT_ONCE = 1 << 15
#: Rows of a block: at least and at most, and the number of blocks aimed at between.
LEAST_ROWS, MOST_ROWS, BLOCKS = 2048, 200_000, 4096
QUERIES_AT_ONCE = 64
_SEED = 20_261


def unit_scaled(x: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two, so that squares neither overflow nor vanish; cosines stay as they are."""
    _, exponent = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -exponent[:, None])


class Forest:
    """The trees of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.x = ids, unit_scaled(vectors)
        self.norm = np.sqrt((self.x * self.x).sum(1))
        self.planes = np.random.default_rng(_SEED).standard_normal((vectors.shape[1], TREES * BITS))
        strings = self.strings(self.x)
        #: Cosines that searches have taken.
        self.scored = 0
        self.order = np.argsort(strings, axis=0, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, 0)

    def strings(self, x: np.ndarray) -> np.ndarray:
        """The hash string of each row (axis 0) in each tree (axis 1)."""
        signs = (x @ self.planes > 0).reshape(len(x), TREES, BITS)
        return (signs << np.arange(BITS - 1, -1, -1, dtype=np.int64)).sum(2)

    def longest(self, strings: np.ndarray) -> np.ndarray:
        """The longest prefix that any row shares with each query (axis 0) in each tree (axis 1): one of the two neighbours in sorted order has it."""
        out = np.zeros(strings.shape, np.int64)
        for t in range(TREES):
            at = np.searchsorted(self.sorted[:, t], strings[:, t])
            for near in (np.maximum(at - 1, 0), np.minimum(at, len(self.ids) - 1)):
                _, bits = np.frexp((strings[:, t] ^ self.sorted[near, t]).astype(np.float64))
                out[:, t] = np.maximum(out[:, t], BITS - bits)
        return out

    def ranges(self, strings: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """In each tree, the range of rows that share a prefix of this depth with each query."""
        low = strings >> (BITS - depth) << (BITS - depth)
        first, last = np.empty_like(low), np.empty_like(low)
        for t in range(TREES):
            first[:, t] = np.searchsorted(self.sorted[:, t], low[:, t])
            last[:, t] = np.searchsorted(self.sorted[:, t], low[:, t] + (1 << (BITS - depth)))
        return first, last

    def gathered(self, queries: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """query * rows + row of the rows in such ranges, each once."""
        pairs = []
        for t in range(TREES):
            size = last[:, t] - first[:, t]
            ends = np.cumsum(size)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[:, t] - (ends - size), size)
            pairs.append(np.repeat(queries, size) * len(self.ids) + self.order[at, t])
        return np.unique(np.concatenate(pairs))

    def screened(self, dense: np.ndarray, queries: np.ndarray, first: np.ndarray, last: np.ndarray, k: int) -> np.ndarray:
        """What `gathered` gives, but only the pairs that may be among the query's k best of them (and its own row); for ranges of much of the block."""
        mine = np.unique(queries)
        inside = np.zeros((len(mine), len(self.ids)), bool)
        row = np.searchsorted(mine, queries)
        for t in range(TREES):
            for i, a, b in zip(row, first[:, t], last[:, t]):
                inside[i, self.order[a:b, t]] = True
        self.scored += int(inside.sum())
        scores = np.where(inside, dense[mine], -np.inf)
        want = min(k + 1, scores.shape[1])
        kth = -np.partition(-scores, want - 1, axis=1)[:, want - 1]
        i, j = np.nonzero(inside & (scores >= kth[:, None] - 1e-9))
        return mine[i] * len(self.ids) + j

    def cosines(self, q: np.ndarray, norm: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        out = np.empty(len(pairs))
        for i in range(0, len(pairs), SCORED_AT_ONCE):
            query, row = np.divmod(pairs[i:i + SCORED_AT_ONCE], len(self.ids))
            out[i:i + SCORED_AT_ONCE] = (self.x[row] * q[query]).sum(1) / (norm[query] * self.norm[row])
        return out

    def search(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the k nearest rows found for each query; only rows that the trees gather are scored."""
        q = unit_scaled(vectors)
        norm = np.sqrt((q * q).sum(1))
        strings = self.strings(q)
        longest = self.longest(strings).max(1)
        best, score = np.empty(0, np.int64), np.empty(0)  # query * rows + row of each query's k best so far
        open_, dense = np.ones(len(q), bool), None
        was_first, was_last = (np.zeros((len(q), TREES), np.int64) for _ in range(2))
        for depth in range(BITS, -1, -1):
            on = np.flatnonzero(open_ & (longest >= depth))
            if not len(on):
                continue
            first, last = self.ranges(strings[on], depth)
            new_query = was_last[on] <= was_first[on]
            inner_first, inner_last = np.where(new_query, last, was_first[on]), np.where(new_query, last, was_last[on])
            added = np.concatenate([on, on]), np.concatenate([first, inner_last]), np.concatenate([inner_first, last])
            was_first[on], was_last[on] = first, last
            if (added[2] - added[1]).sum() * MANY < len(on) * len(self.ids):
                pairs = self.gathered(*added)
                self.scored += len(pairs)
            else:
                if dense is None:
                    dense = (q @ self.x.T) / norm[:, None] / self.norm
                pairs = self.screened(dense, *added, k)
            pairs = np.setdiff1d(pairs, best, assume_unique=True)
            pairs = pairs[ids[pairs // len(self.ids)] != self.ids[pairs % len(self.ids)]]
            best, score = np.concatenate([best, pairs]), np.concatenate([score, self.cosines(q, norm, pairs)])
            order = np.lexsort((self.ids[best % len(self.ids)], -score, best // len(self.ids)))
            best, score = best[order], score[order]
            query = best // len(self.ids)
            place = np.arange(len(query)) - np.searchsorted(query, query)
            best, score, query, place = (x[place < k] for x in (best, score, query, place))
            kth = np.full(len(q), -np.inf)
            kth[query[place == k - 1]] = score[place == k - 1]
            agree = 1 - np.arccos(np.clip(kth, -1, 1)) / math.pi
            open_ &= ~(((1 - agree ** depth) ** TREES <= MISS) & (kth > -np.inf))
        return best // len(self.ids), best % len(self.ids), score


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, forest, held = None, None, []
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            size = batch.column(1).to_numpy(zero_copy_only=False)
            asks = batch.column(2).to_numpy(zero_copy_only=False)
            ids = batch.column(3).to_numpy(zero_copy_only=False)
            flat = batch.column(4).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(size)
            change = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (size[1:] != size[:-1]) | (asks[1:] != asks[:-1])][:len(key)])
            for i, j in zip(change, np.r_[change[1:], len(key)]):
                vectors = flat[ends[i] - size[i]:ends[j - 1]].reshape(j - i, size[i])
                if (key[i], size[i]) != block:
                    block, forest, held = (key[i], size[i]), None, []
                if not asks[i]:
                    held.append((ids[i:j], vectors))
                    continue
                if forest is None and held:
                    forest, held = Forest(*(np.concatenate(x) for x in zip(*held))), []
                for a in range(i, j, QUERIES_AT_ONCE) if forest else ():
                    b = min(j, a + QUERIES_AT_ONCE)
                    query, row, score = forest.search(ids[a:b], vectors[a - i:b - i], k)
                    yield pa.RecordBatch.from_pydict({"query_id": ids[a:b][query], "vec_id": forest.ids[row], "score": score})

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows found for every row that `queries` selects."""
    spark = vectors.sparkSession
    small_batches(spark)
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")) \
        .where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(usable)
    n = rows.count()
    blocks = max(1, -(-n // min(max(n // BLOCKS, LEAST_ROWS), MOST_ROWS)))
    index = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("block"), F.size("v").alias("size"), F.lit(False).alias("asks"), "id", "v")
    asked = rows.where("asks").select("id", "v").distinct().select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.size("v").alias("size"), F.lit(True).alias("asks"), "id", "v")
    found = index.unionByName(asked).repartition("block").sortWithinPartitions("block", "size", "asks") \
        .mapInArrow(_search(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
