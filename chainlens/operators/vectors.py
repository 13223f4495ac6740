"""Wallet vectors against anchors and countries."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector_math import l2_normalize
from ..session import broadcast_if_small, materialize
from . import traffic

AXIS_LIMIT = 20_000
# Cells of one matrix product: 32 MB a float64 array, whatever the batch and the axis.
CELLS = 4_000_000
_CLOSE = 65_536  # near pairs whose differences are taken at a time


def row_chunks(rows: int, width: int, cells: int = CELLS) -> Iterator[slice]:
    """Consecutive slices of ``rows`` rows whose product with ``width`` columns stays within ``cells``."""
    step = max(1, cells // max(1, width))
    for start in range(0, rows, step):
        yield slice(start, min(rows, start + step))


def _score_block(kind: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Scores of every left row with every right row; "unit_dot" scales the left rows to length one."""
    if kind == "dot":
        return left @ right.T
    if kind == "unit_dot":
        length = np.linalg.norm(left, axis=1, keepdims=True)
        return np.divide(left, length, out=left.copy(), where=length > 0) @ right.T
    if kind == "cosine":
        scale = np.linalg.norm(left, axis=1)[:, None] * np.linalg.norm(right, axis=1)[None, :]
        return np.divide(left @ right.T, scale, out=np.zeros_like(scale), where=scale > 0)
    squares = _square_distances(left, right)
    return np.reciprocal(np.sqrt(squares, out=squares) if kind == "inverse_euclidean" else squares, out=squares)


def _square_distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Squared distances from one matrix product, or from the differences where it would cancel; missing for equal vectors."""
    with np.errstate(invalid="ignore", over="ignore"):
        own, other = np.einsum("ij,ij->i", left, left)[:, None], np.einsum("ij,ij->i", right, right)[:, None]
        squares = np.hstack([-2.0 * left, own, np.ones_like(own)]) @ np.hstack([right, np.ones_like(other), other]).T
        least = 1e-3 * (own + (other.max() if len(other) else 0.0))
        near = np.flatnonzero(~(squares.min(axis=1, keepdims=True, initial=np.inf) > least))
        place, column = np.nonzero(~(squares[near] > least[near]))
        row = near[place]
        for at in range(0, len(row), _CLOSE):
            i, j = row[at: at + _CLOSE], column[at: at + _CLOSE]
            exact = ((left[i] - right[j]) ** 2).sum(axis=1)
            squares[i, j] = np.where(exact == 0, np.nan, exact)
    return squares


def _softmax_rows(block: np.ndarray, keys: list) -> np.ndarray:
    raised = np.exp(block - block.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def _share_of_total(block: np.ndarray, keys: list) -> np.ndarray:
    """Rows divided by their value under the empty key; missing where that is 0."""
    total = block[:, [keys.index("")]]
    return np.divide(block, total, out=np.full_like(block, np.nan), where=total != 0)


def score_rows(
    vectors: DataFrame, axis: DataFrame, kind: str = "dot", limit: int = AXIS_LIMIT,
    finish: Callable[[np.ndarray, list], np.ndarray] | None = None, cells: int = CELLS,
) -> DataFrame | None:
    """(id, scores[]) against a sorted axis of at most ``limit`` vectors, else None.

    ``finish`` turns the score rows of a batch into the final ones.

    The axis is read to the driver only up to the limit; each Arrow batch is cut into matrix products of at most
    ``cells`` and nothing is shuffled. Explode the result with an outer explode: a plain one makes Spark add a test
    for empty arrays that runs the matrix product twice. The axis keys come back as the literal column ``keys``.
    """
    rows = axis.select("key", "vector").take(limit + 1)
    if len(rows) > limit:
        return None
    if not rows:
        return vectors.select("id", F.array().cast("array<double>").alias("scores"), F.array().cast("array<string>").alias("keys")).limit(0)
    rows.sort(key=lambda row: row["key"])
    names = [row["key"] for row in rows]
    matrix = np.array([row["vector"] for row in rows], dtype="float64")

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_chunks(batch.num_rows, len(names), cells):
                piece = batch.slice(part.start, part.stop - part.start)
                left = piece.column(1).flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, -1)
                block = _score_block(kind, left, matrix)
                block = finish(block, names) if finish else block
                flat = pa.array(block.ravel(), mask=np.isnan(block.ravel()))
                offsets = pa.array(np.arange(piece.num_rows + 1, dtype=np.int32) * len(names))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["id", "scores"])

    ready = vectors.select("id", F.col("vector").cast("array<double>").alias("vector"))
    scored = ready.mapInArrow(scores, f"id {dict(vectors.dtypes)['id']}, scores array<double>")
    return scored.select("id", "scores", F.lit(names).alias("keys"))


def pair_scores(
    vectors: DataFrame, axis: DataFrame, kind: str = "dot", limit: int = AXIS_LIMIT, cells: int = CELLS
) -> DataFrame:
    """(id, key, score) for every vector and axis entry.

    A short axis rides along with the expression. A long one is cut into blocks that meet shards of
    the vectors by key, one matrix product of at most about ``cells`` per (block, shard): as every pair is a row of the
    result, the copies of the vectors are few beside it.
    """
    ready = score_rows(vectors, axis, kind, limit, cells=cells)
    if ready is not None:
        both = F.explode_outer(F.arrays_zip("keys", "scores"))
        return ready.select("id", both.alias("_s")).select(
            "id", F.col("_s.keys").alias("key"), F.col("_s.scores").alias("score")
        )
    left, right = _sharded(vectors.select("id", "vector"), axis.select("key", "vector"), min(limit, math.isqrt(cells)))

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=["id", "key", "score"], dtype=object)
        block = _score_block(kind, np.stack(a["own_vector"]).astype("float64"), np.stack(b["axis_vector"]).astype("float64"))
        return pd.DataFrame({
            "id": _plain(np.repeat(a["own_id"].to_numpy(), len(b))), "key": _plain(np.tile(b["axis_key"].to_numpy(), len(a))),
            "score": block.ravel(),
        })

    id_type, key_type = dict(vectors.dtypes)["id"], dict(axis.dtypes)["key"]
    return left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInPandas(
        product, f"id {id_type}, key {key_type}, score double"
    ).withColumn("score", F.nanvl("score", F.lit(None)))


class GroupedAxis:
    """Members (key, group, vector) sorted by group: each group is one stretch of the matrix."""

    def __init__(self, keys: Sequence, groups: Sequence, matrix: np.ndarray):
        frame = pd.DataFrame({"key": pd.Series(keys, dtype=object), "group": pd.Series(groups, dtype=object)})
        order = np.lexsort((frame["key"], frame["group"]))
        self.matrix = matrix[order]
        self.keys = frame["key"].to_numpy()[order]
        held = frame["group"].to_numpy()[order]
        self.starts = np.flatnonzero(np.r_[True, held[1:] != held[:-1]]) if len(held) else np.zeros(0, np.int64)
        self.groups = held[self.starts]
        self.sizes = np.diff(np.r_[self.starts, len(held)])
        self.places = pd.DataFrame({"key": self.keys, "column": np.arange(len(self.keys))})

    def own_cells(self, ids: Sequence) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns where an id is the member's own key."""
        met = pd.DataFrame({"key": pd.Series(ids, dtype=object), "row": np.arange(len(ids))}).merge(self.places, on="key")
        return met["row"].to_numpy(), met["column"].to_numpy()

    def sums(self, kind: str, ids: Sequence, left: np.ndarray, skip_self: bool, cells: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(rows, total, number) per group for slices of the rows; no array is over ``cells`` (or a row of it).

        A cosine's sum over a group is the product with the sum of the group's unit vectors, so its cost follows the groups.
        """
        row, column = self.own_cells(ids) if skip_self else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if kind == "cosine" and len(self.keys) and np.isfinite(self.matrix).all() and np.isfinite(left).all():
            units, own = unit_rows(self.matrix), unit_rows(left)
            merged = np.add.reduceat(units, self.starts, axis=0)
            group = np.searchsorted(self.starts, column, side="right") - 1
            for part in row_chunks(len(left), len(self.groups), cells):
                total = _score_block("dot", own[part], merged)
                number = np.tile(self.sizes, (len(total), 1))
                mine = (row >= part.start) & (row < part.stop)
                place = (row[mine] - part.start, group[mine])
                np.subtract.at(total, place, np.einsum("ij,ij->i", own[row[mine]], units[column[mine]]))
                np.subtract.at(number, place, 1)
                yield part, total, number
            return
        for part in row_chunks(len(left), len(self.keys), cells):
            block = _score_block(kind, left[part], self.matrix)
            mine = (row >= part.start) & (row < part.stop)
            block[row[mine] - part.start, column[mine]] = np.nan
            number = np.tile(self.sizes, (len(block), 1))
            odd = np.flatnonzero(np.isnan(block.sum(axis=1)))
            place, missing = np.nonzero(np.isnan(block[odd]))
            block[odd[place], missing] = 0.0
            np.subtract.at(number, (odd[place], np.searchsorted(self.starts, missing, side="right") - 1), 1)
            yield part, np.add.reduceat(block, self.starts, axis=1), number


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay."""
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def mean_scores_by_group(
    vectors: DataFrame, axis: DataFrame, kind: str = "cosine", skip_self: bool = True, limit: int = AXIS_LIMIT,
    cells: int = CELLS,
) -> DataFrame:
    """(id, group, score): mean score of each vector with the members (key, group, vector) of each group.

    Members are averaged inside the matrix product, as sums over stretches of members sorted by group, so no wallet x member
    rows and no member x group table are made. A member with the wallet's own key does not count when ``skip_self``,
    nor does a missing score; a group without any has a null mean.
    """
    columns = ["key", "group", "vector"]
    rows = axis.select(columns).take(limit + 1)
    group_type = dict(axis.dtypes)["group"]
    id_type = dict(vectors.dtypes)["id"]
    if not rows:
        return vectors.select("id", F.lit(None).cast(group_type).alias("group"), F.lit(None).cast("double").alias("score")).limit(0)
    if len(rows) <= limit:
        known = GroupedAxis([r["key"] for r in rows], [r["group"] for r in rows], np.array([r["vector"] for r in rows], dtype="float64"))

        def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = pa.array(known.groups.tolist())
            for batch in batches:
                if not batch.num_rows:
                    continue
                left = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for part, total, number in known.sums(kind, batch.column(0).to_pylist(), left, skip_self, cells):
                    mean = np.divide(total, number, out=np.zeros_like(total), where=number > 0).ravel()
                    which = np.repeat(np.arange(part.start, part.stop), len(names))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(which)), names.take(pa.array(np.tile(np.arange(len(names)), len(total)))),
                         pa.array(mean, mask=number.ravel() == 0)], names=["id", "group", "score"])

        ready = vectors.select("id", F.col("vector").cast("array<double>").alias("vector"))
        return ready.mapInArrow(means, f"id {id_type}, group {group_type}, score double")

    if kind == "cosine":
        found = _mean_cosines(vectors, axis, skip_self, limit, cells)
        if found is not None:
            return found

    def sums_of(a: pa.Table, b: pa.Table) -> pa.Table:
        fields = pa.schema([("id", a["own_id"].type), ("group", b["axis_group"].type), ("total", pa.float64()), ("n", pa.int64())])
        made = [fields.empty_table()]
        if a.num_rows and b.num_rows:
            known = GroupedAxis(b["axis_key"].to_pylist(), b["axis_group"].to_pylist(), _matrix(b["axis_vector"]))
            ids, names = a["own_id"].combine_chunks(), pa.array(known.groups.tolist(), fields.field("group").type)
            for part, total, number in known.sums(kind, ids.to_pylist(), _matrix(a["own_vector"]), skip_self, cells):
                which = np.repeat(np.arange(part.start, part.stop), len(names))
                made.append(pa.table([ids.take(pa.array(which)), names.take(pa.array(np.tile(np.arange(len(names)), len(total)))),
                                      pa.array(total.ravel()), pa.array(number.ravel())], schema=fields))
        return pa.concat_tables(made)

    left, right = _sharded_by_group(vectors.select("id", "vector"), axis.select(columns), min(limit, max(1, cells // 200)))
    parts = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(
        sums_of, f"id {id_type}, group {group_type}, total double, n bigint"
    )
    # A group is in few blocks, so there is little to add before the shuffle; by id alone, what is done per id later stays in place.
    return parts.repartition("id").groupBy("id", "group").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("score"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = held.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(len(held), len(flat) // max(1, len(held)))


def _mean_cosines(vectors: DataFrame, axis: DataFrame, skip_self: bool, limit: int, cells: int) -> DataFrame | None:
    """``mean_scores_by_group`` for cosines over at most ``limit`` groups of any size, else None.

    A group is the sum of its members' unit vectors, so no wallet meets a member but the one of its own key, which is
    taken off again. Members that are not finite have no such sum: None as well.
    """
    id_type, group_type = dict(vectors.dtypes)["id"], dict(axis.dtypes)["group"]

    def merged(by: list[str]) -> DataFrame:
        """(by, vector, n): sum and number of the unit vectors, a row a batch of members and value of ``by``."""
        types = dict(axis.dtypes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = pa.table({c: batch.column(i) for i, c in enumerate(by)}).append_column("_row", pa.array(np.arange(batch.num_rows)))
                found = keys.group_by(by).aggregate([("_row", "list")])["_row_list"].combine_chunks()
                rows, starts = found.flatten().to_numpy(), found.offsets.to_numpy()
                sums = np.add.reduceat(unit_rows(_matrix(batch.column(len(by))))[rows], starts[:-1], axis=0)
                ends = pa.array(np.arange(len(sums) + 1, dtype=np.int32) * sums.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).take(pa.array(rows[starts[:-1]])) for i in range(len(by))],
                     pa.ListArray.from_arrays(ends, pa.array(sums.ravel())), pa.array(np.diff(starts).astype(np.int64))], names=[*by, "vector", "n"])

        given = axis.select(*by, F.col("vector").cast("array<double>").alias("vector"))
        return given.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in by) + ", vector array<double>, n bigint")

    odd = F.exists(F.col("vector").cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if not axis.filter(F.col("vector").isNull() | odd).isEmpty():
        return None
    summed = merged(["group"]).select("group", "n", F.posexplode("vector").alias("_at", "_x")).groupBy("group", "_at").agg(
        F.sum("_x").alias("_x"), F.sum("n").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("_at", "_x")))
    rows = summed.groupBy("group").agg(ordered.getField("_x").alias("vector"), F.max("n").alias("n")).take(limit + 1)
    if len(rows) > limit:
        return None
    place = {row["group"]: i for i, row in enumerate(rows)}
    sums, sizes = np.array([row["vector"] for row in rows]), np.array([row["n"] for row in rows], np.int64)
    ready = vectors.select("id", F.col("vector").cast("array<double>").alias("vector"))
    if skip_self:
        own = merged(["key", "group"]).groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct("group", "vector", "n")).alias("own"))
        ready = ready.join(own, F.col("id") == F.col("_key"), "left").drop("_key")

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(list(place))
        for batch in batches:
            if not batch.num_rows:
                continue
            vector = _matrix(batch.column(1))
            endless = np.isinf(vector).any(axis=1) & ~np.isnan(vector).any(axis=1)
            left = unit_rows(np.where(np.isfinite(vector).all(axis=1, keepdims=True), vector, 0.0))
            row = column = taken = np.zeros(0, np.int64)
            if skip_self:
                own = batch.column(2).flatten()
                row = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().fill_null(0).to_numpy())
                column = np.array([place[g] for g in own.field("group").to_pylist()], np.int64)
                taken = own.field("n").to_numpy()
                score = np.einsum("ij,ij->i", left[row], _matrix(own.field("vector")).reshape(len(row), left.shape[1]))
            for part in row_chunks(batch.num_rows, len(names), cells):
                total, number = left[part] @ sums.T, np.tile(sizes, (part.stop - part.start, 1))
                mine = (row >= part.start) & (row < part.stop)
                if mine.any():
                    np.subtract.at(total, (row[mine] - part.start, column[mine]), score[mine])
                    np.subtract.at(number, (row[mine] - part.start, column[mine]), taken[mine])
                number[endless[part]] = 0
                mean = np.divide(total, number, out=np.zeros_like(total), where=number > 0).ravel()
                which = np.repeat(np.arange(part.start, part.stop), len(names))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(which)), names.take(pa.array(np.tile(np.arange(len(names)), len(total)))),
                     pa.array(mean, mask=number.ravel() == 0)], names=["id", "group", "score"])

    return ready.mapInArrow(means, f"id {id_type}, group {group_type}, score double")


def _sharded_by_group(vectors: DataFrame, axis: DataFrame, side: int) -> tuple[DataFrame, DataFrame]:
    """Both sides keyed by (block, shard), blocks of about ``side`` members of whole groups where they fit.

    A group above ``side`` has blocks of its own; others share blocks. So a (vector, group) has few partial sums, and with long
    blocks and shards the copies of either side are few.
    """
    sizes = broadcast_if_small(axis.groupBy(F.col("group").alias("_group")).agg(F.count("*").alias("_n")))
    shared = max(1, math.ceil(axis.count() / side))
    shards = max(1, math.ceil(vectors.count() / side))
    salt = F.pmod(F.xxhash64("key"), F.ceil(F.col("_n") / F.lit(side)))
    block = F.when(F.col("_n") > side, F.xxhash64("group", salt)).otherwise(F.pmod(F.xxhash64("group"), F.lit(shared)))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint")))
    placed = axis.join(sizes, F.col("group").eqNullSafe(F.col("_group"))).withColumn("block", block)
    blocks = materialize(placed.select("block").distinct())  # about members / side rows
    right = placed.select("block", *[F.col(c).alias(f"axis_{c}") for c in ("key", "group")],
                          F.col("vector").cast("array<double>").alias("axis_vector")).withColumn("shard", every)
    left = vectors.select(F.col("id").alias("own_id"), F.col("vector").cast("array<double>").alias("own_vector"))
    left = left.withColumn("shard", F.pmod(F.xxhash64("own_id"), F.lit(shards))).crossJoin(F.broadcast(blocks))
    return left, right


def _plain(values: np.ndarray) -> pd.Series:
    """Keys as they are: text stays plain objects on its way back to Spark."""
    return pd.Series(values, dtype=object if values.dtype.kind in "OUT" else values.dtype)


def _sharded(vectors: DataFrame, axis: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Both sides keyed by (block, shard): every axis block meets every shard of the vectors once."""
    blocks = math.ceil(axis.count() / limit)
    shards = max(1, math.ceil(vectors.count() / limit))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    # Distinct column names on the two sides: both may come from one table.
    right = axis.select(*[F.col(c).alias(f"axis_{c}") for c in axis.columns])
    right = right.withColumn("block", F.pmod(F.xxhash64("axis_key"), F.lit(blocks))).withColumn("shard", every(shards))
    left = vectors.select(F.col("id").alias("own_id"), F.col("vector").alias("own_vector"))
    left = left.withColumn("shard", F.pmod(F.xxhash64("own_id"), F.lit(shards))).withColumn("block", every(blocks))
    return left, right


def as_vectors(df: DataFrame, id_column: str, name: str = "id", vector: str = "embedding") -> DataFrame:
    return df.select(F.col(id_column).alias(name), F.col(vector).alias("vector"))


def cross_similarity(wallets: DataFrame, anchors: DataFrame, kind: str = "cosine", limit: int = AXIS_LIMIT) -> DataFrame:
    """(id, key, score) for wallets (id, vector) and anchors (key, vector)."""
    return pair_scores(wallets, anchors, kind, limit)


def emb_cos_sim(wallets: DataFrame, anchors: DataFrame, limit: int = AXIS_LIMIT) -> DataFrame:
    return cross_similarity(wallets, anchors, "cosine", limit)


def similarity_matrix(vectors: DataFrame, limit: int = AXIS_LIMIT) -> DataFrame:
    """Cosine of every pair in one set of vectors (key, vector)."""
    return cross_similarity(vectors.withColumnRenamed("key", "id"), vectors, "cosine", limit)


def _best_rows(block: np.ndarray, ids: np.ndarray, names: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the ``n`` highest scores of each column; ``ids`` are sorted, a column's own id is left out."""
    rows, columns = [], []
    for at, name in enumerate(names):
        own = np.flatnonzero(ids != name)
        score = block[own, at]
        if len(own) > n:
            likely = np.flatnonzero(score >= np.partition(score, len(own) - n)[len(own) - n])
            own, score = own[likely], score[likely]
        top = own[np.argsort(-score, kind="stable")[:n]]
        rows.append(top)
        columns.append(np.full(len(top), at))
    return np.concatenate(rows), np.concatenate(columns)


def nearest(vectors: DataFrame, wanted: DataFrame, n: int, limit: int = AXIS_LIMIT, cells: int = CELLS) -> DataFrame:
    """The ``n`` most similar other vectors (id, key, score) for each wanted (key, vector), ties by id.

    Each Arrow batch, or each shard that meets a block of a long list, keeps its own ``n`` best per key, so the pairs
    themselves never leave it. Products stay within ``cells``.
    """
    rows = wanted.select("key", "vector").take(limit + 1)
    id_type, key_type = dict(vectors.dtypes)["id"], dict(wanted.dtypes)["key"]
    schema = f"id {id_type}, key {key_type}, score double"

    def best_of(ids: np.ndarray, left: np.ndarray, names: np.ndarray, right: np.ndarray) -> pd.DataFrame:
        order = np.argsort(ids, kind="stable")
        ids, left, found = ids[order], left[order], []
        for part in row_chunks(len(names), len(ids), cells):
            block = _score_block("cosine", left, right[part])
            at, column = _best_rows(block, ids, names[part], n)
            found.append((ids[at], names[part][column], block[at, column]))
        made = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pd.DataFrame({"id": _plain(made[0]), "key": _plain(made[1]), "score": made[2]})

    if len(rows) > limit:
        left, right = _sharded(vectors.select("id", "vector"), wanted.select("key", "vector"), limit)

        def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if a.empty or b.empty:
                return pd.DataFrame(columns=["id", "key", "score"], dtype=object)
            return best_of(a["own_id"].to_numpy(), np.stack(a["own_vector"]).astype("float64"), b["axis_key"].to_numpy(),
                           np.stack(b["axis_vector"]).astype("float64"))

        scored = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInPandas(product, schema)
    else:
        names = np.array([row["key"] for row in rows], dtype=object)
        matrix = np.array([row["vector"] for row in rows], dtype="float64")

        def batched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch) and len(names):
                    yield best_of(batch["id"].to_numpy(), np.stack(batch["vector"]).astype("float64"), names, matrix)

        scored = vectors.select("id", "vector").mapInPandas(batched, schema)
    shard = F.pmod(F.xxhash64("id"), F.lit(256))
    for part in (shard, F.lit(0)):
        best = Window.partitionBy("key", part).orderBy(F.col("score").desc(), "id")
        scored = scored.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= n).drop("_rank")
    return scored


def country_mean_vector(df: DataFrame, group: str, vector: str = "embedding", size: int = 64) -> DataFrame:
    """Element-wise mean vector per group, as one partial aggregate per element."""
    means = [F.expr(f"avg(CAST(get({vector}, {i}) AS DOUBLE)) AS _m{i}") for i in range(size)]
    averaged = df.groupBy(group).agg(*means)
    return averaged.select(group, F.array(*[f"_m{i}" for i in range(size)]).alias(vector))


def masked_mean(tokens: DataFrame, text: str, mask: str, vector: str = "embedding", size: int = 64) -> DataFrame:
    """Mean over the unmasked vectors of each text; the count is at least 1e-9, so an all-masked text is zeros."""
    sums = [F.expr(f"sum(CAST(get({vector}, {i}) AS DOUBLE) * {mask}) AS _s{i}") for i in range(size)]
    summed = tokens.groupBy(text).agg(*sums, F.expr(f"greatest(sum(CAST({mask} AS DOUBLE)), 1e-9D) AS _n"))
    return summed.selectExpr(text, "array(" + ", ".join(f"_s{i} / _n" for i in range(size)) + f") AS {vector}")


def anchor_multiple(panel: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One anchor per address: (key, vector) and (key, country, value); addresses without a vector drop out."""
    anchors = panel.select("address").distinct().join(vectors.select("address", "embedding"), "address")
    values = panel.join(vectors.select("address"), "address", "left_semi")
    return as_vectors(anchors, "address", "key"), values.select(F.col("address").alias("key"), "country", "value")


def anchor_mean(panel: DataFrame, vectors: DataFrame, size: int = 64) -> tuple[DataFrame, DataFrame]:
    """One anchor per exchange: mean vector of its addresses and mean value per country."""
    known = panel.join(vectors.select("address"), "address", "left_semi")
    members = known.select("exchange", "address").distinct().join(vectors.select("address", "embedding"), "address")
    means = country_mean_vector(members, "exchange", size=size)
    values = known.groupBy(F.col("exchange").alias("key"), "country").agg(F.avg("value").alias("value"))
    return as_vectors(means, "exchange", "key"), values


def country_axis(anchors: DataFrame, values: DataFrame, size: int = 64, normalize: bool = True) -> DataFrame:
    """(key = country, vector = sum of anchor value times anchor vector).

    Scoring a wallet against this axis equals similarity to every anchor times the country matrix,
    without ever making the wallet x anchor rows.
    """
    unit = anchors.select("key", (l2_normalize("vector") if normalize else F.col("vector")).alias("vector"))
    joined = values.join(unit, "key")
    sums = [F.expr(f"sum(value * coalesce(get(vector, {i}), 0.0D)) AS _s{i}") for i in range(size)]
    summed = joined.groupBy("country").agg(*sums)
    return summed.select(F.col("country").alias("key"), F.array(*[f"_s{i}" for i in range(size)]).alias("vector"))


def country_prob(wallets: DataFrame, anchors: DataFrame, values: DataFrame, size: int = 64) -> DataFrame:
    """(id, key = country, score): cosine to the anchors times the country matrix."""
    return pair_scores(wallets, country_axis(anchors, values, size), "unit_dot")


def wallet_country(wallets: DataFrame, anchors: DataFrame, values: DataFrame, size: int = 64) -> DataFrame:
    """(id, country, prob): the same scores through a softmax per wallet."""
    axis = country_axis(anchors, values, size)
    ready = score_rows(wallets, axis, "unit_dot", finish=_softmax_rows)
    if ready is None:
        return softmax_by(pair_scores(wallets, axis, "unit_dot"), ["id"], "score", "prob").select(
            "id", F.col("key").alias("country"), "prob"
        )
    soft = ready.select("id", F.explode_outer(F.arrays_zip("keys", "scores")).alias("_s"))
    return soft.select("id", F.col("_s.keys").alias("country"), F.col("_s.scores").alias("prob"))


def weighted_country(wallets: DataFrame, anchors: DataFrame, values: DataFrame, size: int = 64) -> DataFrame:
    """(id, key = country, score): similarity rows scaled to sum one, then times the country matrix.

    The row sum is one more axis vector, the sum of all unit anchors, under the empty key.
    """
    everything = anchors.select("key", F.lit("").alias("country"), F.lit(1.0).alias("value"))
    axis = country_axis(anchors, values.select("key", "country", "value").unionByName(everything), size)
    ready = score_rows(wallets, axis, "unit_dot", finish=_share_of_total)
    if ready is not None:
        pairs = ready.select("id", F.explode_outer(F.arrays_zip("keys", "scores")).alias("_p")).select(
            "id", F.col("_p.keys").alias("key"), F.col("_p.scores").alias("score")
        )
        return pairs.filter(F.col("key") != "")
    scores = pair_scores(wallets, axis, "unit_dot")
    totals = scores.filter(F.col("key") == "").select("id", F.col("score").alias("_total"))
    return scores.filter(F.col("key") != "").join(totals, "id").select(
        "id", "key", F.try_divide("score", "_total").alias("score")
    )


def reweight_inverse_frequency(values: DataFrame, alpha: float = 1.0, epsilon: float = 1e-12) -> DataFrame:
    """Divide by (mean value of the country + epsilon) ^ alpha, then scale each anchor to sum one."""
    means = values.groupBy("country").agg(F.avg("value").alias("_mean"))
    weighted = values.join(means, "country").withColumn(
        "value", F.col("value") / F.pow(F.col("_mean") + F.lit(epsilon), F.lit(alpha))
    ).drop("_mean")
    totals = weighted.groupBy("key").agg(F.sum("value").alias("_total"))
    return weighted.join(totals, "key").select("key", "country", F.try_divide("value", "_total").alias("value"))


def softmax_by(df: DataFrame, group: list[str], x: str, out: str, tau: float | None = None) -> DataFrame:
    """exp((x - max) / tau) / sum within ``group``; ``tau`` is 1 if not given. The shift keeps large scores finite.

    Maxima and sums are partial aggregates joined back, so a large group is never in one task.
    """
    tops = df.groupBy(*group).agg(F.max(x).alias("_top"))
    raised = df.join(tops, group).withColumn("_e", F.exp((F.col(x) - F.col("_top")) / F.lit(1.0 if tau is None else tau))).drop("_top")
    totals = raised.groupBy(*group).agg(F.sum("_e").alias("_total"))
    return raised.join(totals, group).withColumn(out, F.col("_e") / F.col("_total")).drop("_e", "_total")


def standardize(df: DataFrame, group: list[str], x: str, out: str) -> DataFrame:
    """(x - min) / sum of (x - min) within ``group``; null when all values are equal."""
    lows = df.groupBy(*group).agg(F.min(x).alias("_low"))
    shifted = df.join(lows, group).withColumn("_shift", F.col(x) - F.col("_low")).drop("_low")
    totals = shifted.groupBy(*group).agg(F.sum("_shift").alias("_total"))
    return shifted.join(totals, group).withColumn(out, F.try_divide("_shift", "_total")).drop("_shift", "_total")


def score_wallets(
    wallets: DataFrame, anchors: DataFrame, trend: DataFrame, kind: str = "cosine", normalizer: str = "softmax",
    mode: str = "multiple", n: int | None = None, size: int = 64,
) -> DataFrame:
    """(wallet, country, score, norm_score): search-trend ranking of countries for every wallet.

    ``anchors`` is (address, exchange, embedding). ``mode`` compares with each address and averages
    per exchange, or with the exchange's mean vector. A wallet is not compared with its own address.
    """
    if mode == "multiple":
        members = anchors.select(F.col("address").alias("key"), F.col("exchange").alias("group"), F.col("embedding").alias("vector"))
    else:
        means = country_mean_vector(anchors, "exchange", size=size)
        members = means.select(F.col("exchange").alias("key"), F.col("exchange").alias("group"), F.col("embedding").alias("vector"))
    means_by_exchange = mean_scores_by_group(wallets, members, kind)
    similarity = means_by_exchange.select(
        F.col("id").alias("wallet"), F.col("group").alias("exchange"), F.col("score").alias("similarity")
    )
    scores = materialize(traffic.country_score(traffic.join_trend_similarity(trend, similarity)))  # the normalizers read it more than once
    if normalizer == "softmax":
        ranked = softmax_by(scores, ["wallet"], "score", "norm_score", tau=0.1)
    else:
        ranked = standardize(scores, ["wallet"], "score", "norm_score")
    if n is None:
        return ranked
    best = Window.partitionBy("wallet").orderBy(F.col("norm_score").desc(), "country")
    return ranked.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= n).drop("_rank")
