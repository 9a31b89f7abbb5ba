"""Nearest neighbours by largest inner product: a block matrix join on int8 codes with error bounds.

Queries and candidates are dealt into blocks, and every pair of a query block
and a candidate block is one unit of work: a tile. In a tile, products of int8
codes bound each inner product from both sides; pairs whose upper bound can't
reach the query's k-th best so far are dropped, the rest are recomputed in
double precision from the original vectors, and a heap for each query merges
what survives. The result is exact: a bound never drops a true neighbour.

A tile holds its query block and one batch of candidates at a time. Rows are
replicated once per block of the other side, and what a tile returns is at
most k rows for each of its queries, merged by a second k-th best cut.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite
component, and rows with a null id, take no part, neither do vectors of
another length than a query's; ties go to the smaller id; repeated ids are
separate candidates, but none with the query's own id; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Vectors in a query block and in a candidate block, on average.
QUERY_BLOCK, CANDIDATE_BLOCK = 8192, 16384
#: Candidates that a query block meets at once: products of 8192 x 256 take some 50 MB.
BATCH = 256
#: Pairs that are recomputed at once.
PAIRS = 200_000


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    return out.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(finite & F.exists("v", lambda x: x != 0))


def _codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scale, the length of each vector and of its quantisation error, both rounded up."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1
    code = np.rint(x / scale[:, None])
    error = np.sqrt(((x - code * scale[:, None]) ** 2).sum(axis=1))
    return code.astype(np.int8), scale, np.sqrt((x * x).sum(axis=1)) * (1 + 1e-9), error * (1 + 1e-9) + 1e-300


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, summed component by component in double precision."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        total += q[:, d] * c[:, d]
    return total


class Tile:
    """A block of queries and their best candidates so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        self.ids, self.x, self.k = ids, x, k
        self.code, self.scale, self.norm, self.error = _codes(x)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]  # (score, -id): the root is the worst kept
        self.least = np.full(len(ids), -np.inf)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        if not len(self.ids) or not len(ids):
            return
        code, scale, norm, error = _codes(x)
        # int8 products are whole numbers, exact in single precision up to 2**24, else in double
        kind = np.float32 if x.shape[1] * 127 * 127 < 2**24 else np.float64
        about = (self.code.astype(kind) @ code.astype(kind).T).astype(np.float64) * self.scale[:, None] * scale
        # |qc - q'c'| <= |q - q'| |c| + |q'| |c - c'|, where |q'| <= |q| + |q - q'|
        slack = (self.error[:, None] * norm + (self.norm + self.error)[:, None] * error) * (1 + 1e-9) + 1e-12 * self.norm[:, None] * norm
        about[self.ids[:, None] == ids] = -np.inf
        if about.shape[1] > self.k:
            # the k-th best lower bound of this batch is a bound for the true k-th best, too
            low = np.partition(about - slack, -self.k, axis=1)[:, -self.k]
            self.least = np.maximum(self.least, np.where(np.isfinite(low), low, -np.inf))
        row, col = np.nonzero((about + slack >= self.least[:, None]) & np.isfinite(about))
        for at in range(0, len(row), PAIRS):
            r, c = row[at : at + PAIRS], col[at : at + PAIRS]
            s, i = exact(self.x[r], x[c]), ids[c]
            keep = s >= self.least[r]
            r, s, i = r[keep], s[keep], i[keep]
            order = np.lexsort((i, -s, r))
            r, s, i = r[order], s[order], i[order]
            first = np.r_[True, r[1:] != r[:-1]] if len(r) else np.zeros(0, bool)
            rank = np.arange(len(r)) - np.maximum.accumulate(np.where(first, np.arange(len(r)), 0))
            for q, score, cand in zip(*(a[rank < self.k].tolist() for a in (r, s, i))):
                heap, item = self.heaps[q], (score, -cand)
                if len(heap) < self.k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
            for q in np.unique(r).tolist():
                if len(self.heaps[q]) == self.k:
                    self.least[q] = max(self.least[q], self.heaps[q][0][0])

    def rows(self) -> pa.RecordBatch:
        found = [(q, -i, s) for q, heap in zip(self.ids.tolist(), self.heaps) for s, i in heap]
        q, i, s = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query. ``is_query``: a condition on ``id``."""
    good = usable(vectors, id_col, vector_col).withColumn("dim", F.size("v"))
    n_queries, n = good.agg(F.count(F.when(is_query, 1)), F.count(F.lit(1))).first()
    blocks = {"q": max(1, -(-n_queries // QUERY_BLOCK)), "c": max(1, -(-n // CANDIDATE_BLOCK))}
    block = lambda side: F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks[side]))
    every = lambda side: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks[side] - 1).cast("long")))
    queries = good.filter(is_query).select("dim", block("q").alias("qb"), every("c").alias("cb"), F.lit(0).alias("side"), "id", "v")
    candidates = good.select("dim", every("q").alias("qb"), block("c").alias("cb"), F.lit(1).alias("side"), "id", "v")
    tiles = queries.unionByName(candidates).repartition("dim", "qb", "cb").sortWithinPartitions("dim", "qb", "cb", "side")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tile = None, None
        asked: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            key = np.stack([batch.column(j).to_numpy() for j in range(4)]) if batch.num_rows else np.zeros((4, 0), np.int64)
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                here = tuple(key[:3, lo].tolist())
                if here != at:
                    if tile is not None:
                        yield tile.rows()
                    at, tile, asked = here, None, []
                ids = batch.column(4).slice(lo, hi - lo).to_numpy()
                x = batch.column(5).slice(lo, hi - lo).flatten().to_numpy().reshape(hi - lo, here[0])
                if key[3, lo] == 0:
                    asked.append((ids, x))
                elif asked or tile is not None:
                    if tile is None:
                        tile, asked = Tile(np.concatenate([i for i, _ in asked]), np.concatenate([v for _, v in asked]), k), []
                    for c in range(0, hi - lo, BATCH):
                        tile.add(ids[c : c + BATCH], x[c : c + BATCH])
        if tile is not None:
            yield tile.rows()

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = tiles.mapInArrow(join, "query_id long, vec_id long, score double")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


ORACLE_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: x::double) e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (
  select q.vec_id query_id, c.vec_id,
         list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda a, b: a + b) score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) rnk, vec_id, score from p)
select query_id, cast(rnk as integer) "rank", vec_id, score from r where rnk <= 20
"""
