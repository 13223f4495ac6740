"""Running totals over range-sorted rows, and digests of long ordered groups, without gathering a group.

A group of any size is a few fragments in neighbouring range partitions. A first pass adds up the fragments at the ends of
every partition; the driver turns those, two small rows a partition, into the totals before each; a second pass runs
through the rows once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import materialize

SUM, XOR = "sum", "xor"


def longs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values (null: 0) and the null mask of a column of whole numbers."""
    return np.asarray(column.fill_null(0).cast(pa.int64())), np.asarray(column.is_null())


def group_starts(column: pa.Array) -> np.ndarray:
    """Places in a batch where another group begins, with 0 first."""
    values, null = longs(column)
    return np.flatnonzero(np.r_[True, (values[1:] != values[:-1]) | (null[1:] != null[:-1])])


def sort_by_range(df: DataFrame, order: Sequence[str], part: str = "_part") -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, with its partition number, fixed by a checkpoint."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(placed.withColumn(part, F.spark_partition_id()))


def _through(kind: str, values: np.ndarray, starts: np.ndarray, before: int) -> np.ndarray:
    """Running totals of each group of a batch; ``before`` belongs to the group that the batch opens with."""
    run = np.bitwise_xor.accumulate(values) if kind == XOR else np.cumsum(values)
    lengths = np.diff(np.r_[starts, len(values)])
    offsets = np.r_[0, run[starts[1:] - 1]].astype(np.int64)
    if kind == XOR:
        offsets[0] = before
        return run ^ np.repeat(offsets, lengths)
    offsets[0] = -before
    return run - np.repeat(offsets, lengths)


def running_totals(df: DataFrame, group: str, order: Sequence[str], totals: dict[str, tuple[Column, str]]) -> DataFrame:
    """``df`` with running totals (sum, or xor of hashes) inside ``group`` in the order (group, ``order``), own row included."""
    names, kinds = list(totals), [kind for _, kind in totals.values()]
    rows = df.withColumns({name: value.cast("bigint") for name, (value, _) in totals.items()})
    fixed = sort_by_range(rows, [group, *order])
    columns = [c for c in fixed.columns if c != "_part"]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(1 + len(names))[0].as_py()
            starts = group_starts(batch.column(0))
            values = [longs(batch.column(i + 1))[0] for i in range(len(names))]
            for k in sorted({0, len(starts) - 1}):
                a, b = starts[k], starts[k + 1] if k + 1 < len(starts) else batch.num_rows
                own = [int(np.bitwise_xor.reduce(v[a:b]) if kind == XOR else v[a:b].sum())
                       for v, kind in zip(values, kinds, strict=True)]
                key = batch.column(0)[int(a)].as_py()
                if found and found[-1][1] == key:
                    found[-1][2] = [x ^ y if kind == XOR else x + y for x, y, kind in zip(found[-1][2], own, kinds, strict=True)]
                else:
                    del found[1:]
                    found.append([part, key, own])
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int64()),
             pa.array([f[2] for f in found], pa.list_(pa.int64()))], names=["part", "key", "own"])

    found = fixed.select(F.col(group).cast("bigint").alias("key"), *names, "_part").mapInArrow(
        ends, "part int, key bigint, own array<bigint>")
    before: dict[int, list[int]] = {}
    held: tuple[int | None, list[int]] | None = None
    for part, key, own in sorted((tuple(r) for r in found.collect()), key=lambda r: r[0]):  # stable: first end, then last
        if part not in before:
            before[part] = held[1] if held and held[0] == key else [0] * len(names)
        if held and held[0] == key:
            own = [x ^ y if kind == XOR else x + y for x, y, kind in zip(held[1], own, kinds, strict=True)]
        held = (key, own)

    at = {c: i for i, c in enumerate(columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(at[group])
            if carried is None:
                carried = before[batch.column(len(columns))[0].as_py()]
            elif keys[0].as_py() != last:
                carried = [0] * len(names)
            starts = group_starts(keys)
            made = [_through(kind, longs(batch.column(at[name]))[0], starts, start)
                    for name, kind, start in zip(names, kinds, carried, strict=True)]
            carried, last = [int(m[-1]) for m in made], keys[batch.num_rows - 1].as_py()
            kept = [pa.array(made[names.index(c)]) if c in names else batch.column(at[c]) for c in columns]
            yield pa.RecordBatch.from_arrays(kept, names=columns)

    schema = StructType([StructField(f.name, LongType()) if f.name in names else f for f in fixed.schema if f.name != "_part"])
    return fixed.mapInArrow(run, schema)


def join_split(rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: Column, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined by equal (null-safe) ``keys`` with ``table``, which has a row a key.

    ``weight`` is the number of rows of a key among all ``total``; keys with a 1/1,024 share of them, at most 1,024, are
    broadcast, the rest is joined by key. ``rows`` is read twice: give a materialized table.
    """
    own = [c for c in table.columns if c not in keys]
    right = table.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *own, (weight * 1024 >= max(total, 4096)).alias("_hot"))
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = same if on is None else on & same
    hot = F.broadcast(right.where("_hot"))
    heavy = rows.join(hot, on, "inner")
    rest = rows.join(F.broadcast(right.where("_hot").select(*[f"_r_{k}" for k in keys])), on, "left_anti")
    light = rest.join(right.where("NOT _hot"), on, how)
    chosen = [*rows.columns, *own]
    return heavy.select(*chosen).unionByName(light.select(*chosen))


def ordered_digests(rows: DataFrame, keys: Sequence[str], order: Sequence[str], piece: str, separator: str) -> DataFrame:
    """(keys, sha256): lowercase hex of each group's pieces in order, joined. ``keys`` are bigint columns.

    A digest is one chain over the whole group, so a group passes through one task, but as a sorted stream (spilled by
    Spark's sort) into one running state: memory does not grow with the group.
    """
    placed = rows.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, piece)
    glue = separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, empty = None, None, True
        for batch in batches:
            done: list[tuple] = []
            for key, value in zip(zip(*[batch.column(i).to_pylist() for i in range(len(keys))], strict=True),
                                  batch.column(len(keys)).to_pylist(), strict=True):
                if state is None or key != held:
                    if state is not None:
                        done.append((*held, state.hexdigest()))
                    held, state, empty = key, hashlib.sha256(), True
                if not empty:
                    state.update(glue)
                state.update(value.encode())
                empty = False
            if done:
                yield _digest_batch(done, keys)
        if state is not None:
            yield _digest_batch([(*held, state.hexdigest())], keys)

    return placed.mapInArrow(run, ", ".join([*[f"`{k}` bigint" for k in keys], "sha256 string"]))


def _digest_batch(done: list[tuple], keys: Sequence[str]) -> pa.RecordBatch:
    columns = list(zip(*done, strict=True))
    return pa.RecordBatch.from_arrays(
        [*[pa.array(c, pa.int64()) for c in columns[:-1]], pa.array(columns[-1], pa.string())], names=[*keys, "sha256"])
