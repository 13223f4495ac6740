"""Exact top-k search by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are turned into whole numbers, floor(scale * x). Candidates are dealt into shards by hash of their id and queries
into blocks, and each shard meets each block once, as packed groups; no row is paired with another by a join.
Within a group every dimension has a list of the shard's candidates sorted by their value. A query reads all lists at once, from
the end that its own component favours, a run of entries at a time; each candidate met for the first time is scored in
full. The sum over dimensions of component times the last value read bounds every candidate not yet met; reading stops when
that bound is below the k-th score (not at equality, as a smaller id could still tie). The shards' best are merged by key.

Sizes: a shard has about SHARD candidates and a block about BLOCK queries, set from counts, so memory does not grow.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; only vectors of the same length
meet; rows that repeat an id are candidates of their own for other ids, but never for their own id; ties go to the smaller id;
with fewer candidates than k all are given; ids that are null take no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD = 8192
BLOCK = 2048
_RUN = 64  # entries read from each list at a time; doubled every time


def whole_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v, dim): usable rows with floor(scale * x) for every component x."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad
    made = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    return table.where(usable).select(F.col(id_col).cast("bigint").alias("id"), made.alias("v"), F.size(v).alias("dim"))


class Lists:
    """Per-dimension lists of a shard's candidates, and the threshold algorithm over them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.exact_in_float = float(np.abs(vectors).max(initial=0)) ** 2 * vectors.shape[1] < 2.0**52
        if self.exact_in_float:  # whole numbers below 2**53 are exact, and floats multiply faster
            self.vectors = self.vectors.astype(np.float64)
        self.lists = np.argsort(self.vectors, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(self.vectors, self.lists.T, axis=0).T.copy()

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        count, dims = self.vectors.shape
        exact = self.exact_in_float and float(np.abs(query).max()) * float(np.abs(self.vectors).max()) * dims < 2.0**52
        if exact:
            query, vectors = query.astype(np.float64), self.vectors
        else:
            vectors = self.vectors.astype(np.int64)
        used = np.flatnonzero(query)
        high = used[query[used] > 0]
        low = used[query[used] < 0]
        met = self.ids == query_id
        best_at = np.zeros(0, np.int64)
        best = np.zeros(0, vectors.dtype)
        depth, run = 0, _RUN
        while depth < count:
            upto = min(count, depth + run)
            fresh = np.zeros(count, bool)
            if not len(used):
                fresh[:], upto = True, count
            fresh[self.lists[high, count - upto: count - depth].ravel()] = True
            fresh[self.lists[low, depth:upto].ravel()] = True
            fresh &= ~met
            at = np.flatnonzero(fresh)
            met[at] = True
            if len(at):
                scores = np.concatenate([best, vectors[at] @ query])
                places = np.concatenate([best_at, at])
                if len(scores) > k:
                    least = np.partition(scores, len(scores) - k)[len(scores) - k]
                    likely = np.flatnonzero(scores >= least)
                    scores, places = scores[likely], places[likely]
                chosen = np.lexsort((self.ids[places], -scores))[:k]
                best, best_at = scores[chosen], places[chosen]
            depth, run = upto, run * 2
            if len(best) == k:
                bound = (query[high] * self.values[high, count - depth]).sum() if depth else 0
                bound = bound + (query[low] * self.values[low, depth - 1]).sum()
                if bound < best[-1]:
                    break
        return self.ids[best_at], best.astype(np.int64)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().values.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def exact_top_k(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256, every: int = 50,
    shard: int = SHARD, block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, id, score): for each query, an id divisible by ``every``, the k highest inner products."""
    rows = whole_vectors(table, id_col, vector_col, scale)
    sizes = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("q")).first()
    shards, blocks = max(1, -(-sizes["n"] // shard)), max(1, -(-sizes["q"] // block))
    spread = F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")
    dealt = F.pmod(F.xxhash64(F.lit(1), "id", "v"), F.lit(blocks)).cast("int")
    candidates = rows.select("id", "v", "dim", spread.alias("s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    queries = rows.where(F.col("id") % every == 0).select(
        "id", "v", "dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), dealt.alias("b")
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            lists = Lists(left.column("id").to_numpy(), _matrix(left.column("v"), dim))
            for query_id, query in zip(right.column("id").to_pylist(), _matrix(right.column("v"), dim), strict=True):
                ids, scores = lists.search(query_id, query, k)
                found.append((query_id, ids, scores))
        return pa.table({
            "query_id": pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)),
            "vec_id": pa.array(np.concatenate([f[1] for f in found] or [np.zeros(0, np.int64)]).astype(np.int64)),
            "score": pa.array(np.concatenate([f[2] for f in found] or [np.zeros(0, np.int64)]).astype(np.int64)),
        })

    keys = ["s", "b", "dim"]
    near = candidates.groupBy(*keys).cogroup(queries.distinct().groupBy(*keys)).applyInArrow(
        run, "query_id bigint, vec_id bigint, score bigint"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
