"""Exact top-k search by inner product with MaxScore.

A query's terms are its components; a term's postings in a block of candidates are the components of that dimension, and its
score bounds are the least and the greatest product it can give there.  In every block a query splits its terms, the widest
bounds first: the non-essential ones are those that cannot lift a candidate to the k-th best score as long as the essential
ones give their least.  Essential postings are traversed for all candidates of the block; the non-essential ones are probed
some at a time, only for candidates that are still competitive, that is, whose score so far and the greatest products of the
terms to come reach the k-th best score.  A block whose bounds together do not reach it is passed over.

Blocks are cut from the table's partitions (shards).  A first pass over a hundredth of the candidates, chosen by hash, gives
every query a k-th best score to start from: it is a score of real candidates, hence a proven bound, and every shard then
returns only what reaches it.  The shards' best are merged by a window that keeps k rows of each task before the shuffle.

Queries are sent to the workers.  Their size is summed first; beyond ``QUERY_BYTES`` they are dealt by hash into groups of
that size, and every group is a pass over all candidates, whose work is far above that of reading them.

Defined cases: a query or candidate that is null, has a null or non-finite component or a null id takes no part; a vector
shorter than another is filled up with zeros; a row's own id is never among its candidates; repeated rows are candidates
each, and equal queries (id and vector) give one result; ties of score go to the smaller id; a query with fewer candidates
than k gets them all; empty tables give an empty result; further columns are not used.  Scores that could exceed 64 bits
are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stage

#: Candidates of a block, bytes of the queries of one pass, terms probed at a time, rows of a batch returned.
BLOCK, QUERY_BYTES, PROBE, ROWS = 4096, 32 << 20, 4, 65_536
#: The first pass takes one candidate in so many.
FIRST = 100
_FOUND = "query long, vec_id long, score long"

Queries = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # numbers, ids, vectors, scores to start from


def usable(vector: Column) -> Column:
    """Vectors without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def quantised(vector: Column, scale: int = 1024) -> Column:
    """Components as whole numbers."""
    return F.transform(vector, lambda x: F.floor(scale * x.cast("double")).cast("long"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros or cut at ``width`` (what is beyond meets zeros)."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row[place < width], place[place < width]] = flat[place < width]
    return out


class Best:
    """The best k candidates of each query, from the shard's blocks one after the other."""

    def __init__(self, queries: Queries, k: int) -> None:
        self.numbers, self.own, self.vectors, start = queries
        self.k, self.least = k, start.copy()
        self.ids = [np.empty(0, dtype=np.int64)] * len(self.numbers)
        self.scores = [np.empty(0, dtype=np.int64)] * len(self.numbers)
        self.floor = np.iinfo(np.int64).min

    def add(self, ids: np.ndarray, block: np.ndarray) -> None:
        if not len(ids) or not len(self.numbers):
            return
        reach = float(np.abs(block).max(initial=0)) * float(np.abs(self.vectors).max(initial=0)) * max(block.shape[1], 1)
        if reach >= 2.0 ** 62:
            raise ArithmeticError("scores beyond 64 bits")
        postings = np.ascontiguousarray(block.T)
        if reach < 2.0 ** 53:  # products and sums are whole numbers in doubles, too
            postings = postings.astype(np.float64)
        low, high = block.min(axis=0), block.max(axis=0)
        ends = np.stack([self.vectors * low, self.vectors * high])
        least, most = ends.min(axis=0), ends.max(axis=0)
        order = np.argsort(least - most, axis=1, kind="stable")  # widest bounds first
        least, most = np.take_along_axis(least, order, 1), np.take_along_axis(most, order, 1)
        rest = np.concatenate([np.cumsum(most[:, ::-1], axis=1)[:, ::-1], np.zeros((len(order), 1), dtype=np.int64)], axis=1)
        floor = np.concatenate([np.zeros((len(order), 1), dtype=np.int64), np.cumsum(least, axis=1)], axis=1)
        for q in np.flatnonzero(rest[:, 0] >= self.least):
            self._query(q, ids, postings, order[q], rest[q], floor[q])

    def _query(self, q: int, ids: np.ndarray, postings: np.ndarray, order: np.ndarray, rest: np.ndarray, floor: np.ndarray) -> None:
        bound = self.least[q]
        essential = int(np.argmax(floor + rest < bound)) if bound > self.floor and (floor + rest < bound).any() else len(order)
        vector = self.vectors[q][order].astype(postings.dtype)
        partial = vector[:essential] @ postings[order[:essential]] if essential else np.zeros(len(ids), dtype=postings.dtype)
        left = np.flatnonzero((partial >= bound - rest[essential]) & (ids != self.own[q])) if bound > self.floor else np.flatnonzero(ids != self.own[q])
        partial = partial[left]
        for at in range(essential, len(order), PROBE):  # probe while competitive
            if not len(left):
                return
            terms = order[at:at + PROBE]
            partial = partial + vector[at:at + PROBE] @ postings[terms[:, None], left]
            keep = partial >= bound - rest[min(at + PROBE, len(order))]
            left, partial = left[keep], partial[keep]
        if not len(left):
            return
        scores = np.concatenate([self.scores[q], partial.astype(np.int64)])
        found = np.concatenate([self.ids[q], ids[left]])
        if len(scores) > 4 * self.k:  # ties of the k-th best stay for the order by id
            cut = np.partition(scores, -self.k)[-self.k]
            found, scores = found[scores >= cut], scores[scores >= cut]
        best = np.lexsort((found, -scores))[:self.k]
        self.ids[q], self.scores[q] = found[best], scores[best]
        if len(best) == self.k:
            self.least[q] = max(bound, scores[best[-1]])

    def batches(self) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        size = 0
        for q in range(len(self.numbers) + 1):
            if held and (q == len(self.numbers) or size >= ROWS):
                sizes = [len(self.ids[i]) for i in held]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(self.numbers[held], sizes)), pa.array(np.concatenate([self.ids[i] for i in held])),
                     pa.array(np.concatenate([self.scores[i] for i in held]))], names=["query", "vec_id", "score"])
                held, size = [], 0
            if q < len(self.numbers) and len(self.ids[q]):
                held.append(q)
                size += len(self.ids[q])


def _searcher(sent: Broadcast, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(sent.value, k)
        width = best.vectors.shape[1]
        ids: list[np.ndarray] = []
        blocks: list[np.ndarray] = []
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                ids.append(part.column(0).to_numpy(zero_copy_only=False))
                blocks.append(_matrix(part.column(1), width))
                if sum(map(len, ids)) >= BLOCK:
                    best.add(np.concatenate(ids), np.concatenate(blocks))
                    ids, blocks = [], []
        if ids:
            best.add(np.concatenate(ids), np.concatenate(blocks))
        yield from best.batches()

    return search


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def search(base: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding",
           query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` greatest inner products of each query with whole-number vectors."""
    spark = base.sparkSession
    prepared = [t.filter(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")) for t in (base, queries)]
    candidates = prepared[0]
    asked = stage(prepared[1].dropDuplicates().withColumn("query", F.monotonically_increasing_id()))
    size = asked.agg(F.sum(8 * F.size("vector") + 64), F.max(F.size("vector"))).first()
    groups, width = max(1, -(-(size[0] or 0) // query_bytes)), size[1] or 0
    part = F.pmod(F.xxhash64("query"), F.lit(groups))
    found = None
    for g in range(groups):
        group = asked.filter(part == g).toArrow().combine_chunks()
        numbers, own = [group.column(c).to_numpy() for c in ("query", "vec_id")]
        vectors = group.column("vector").combine_chunks()
        vectors = _matrix(vectors if isinstance(vectors, pa.ListArray) else vectors.chunk(0), width) if len(numbers) else np.zeros((0, width), np.int64)
        start = np.full(len(numbers), np.iinfo(np.int64).min)
        if len(numbers):
            first = candidates.filter(F.pmod(F.xxhash64("vec_id"), F.lit(FIRST)) == 0)
            sent = spark.sparkContext.broadcast((numbers, own, vectors, start))
            reached = _top(first.mapInArrow(_searcher(sent, k), _FOUND), k).filter(F.col("rank") == k).select("query", "score").toArrow()
            place = {q: i for i, q in enumerate(numbers.tolist())}
            for q, score in zip(reached.column("query").to_pylist(), reached.column("score").to_pylist(), strict=True):
                start[place[q]] = score
        sent = spark.sparkContext.broadcast((numbers, own, vectors, start))
        one = candidates.mapInArrow(_searcher(sent, k), _FOUND)
        found = one if found is None else found.unionByName(one)
    return _top(found, k).join(asked.select("query", F.col("vec_id").alias("query_id")), "query").select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
