"""Running sums, ranks and dense ids that never put one large group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    block: str,
    order: Sequence[str | Column],
    value: str,
    out: str,
    total: str | None = None,
) -> DataFrame:
    """Sum of ``value`` from the start of the group to the current row.

    ``block`` cuts every group into consecutive ranges of ``order``; rows are only ever gathered per
    (keys, block), and a second, small pass adds the totals of the earlier blocks.
    """
    keys = list(keys)
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, block).agg(F.sum(value).alias("_block_sum"))
    starts = sums.withColumn("_start", F.coalesce(F.sum("_block_sum").over(earlier), F.lit(0)))
    if total:
        starts = starts.withColumn(total, F.sum("_block_sum").over(Window.partitionBy(*keys)))
    return (
        df.withColumn("_inside", F.sum(value).over(inside))
        .join(starts.drop("_block_sum"), [*keys, block])
        .withColumn(out, F.col("_inside") + F.col("_start"))
        .drop("_inside", "_start")
    )


def hash_rank(
    df: DataFrame, keys: Sequence[str], draw: str, tie: Sequence[str], out: str, blocks: int = 1024,
    total: str | None = None,
) -> DataFrame:
    """1-based rank inside each group by a uniform in [0, 1), ties by ``tie``.

    The uniform itself cuts every group into even blocks, so a class with most of the rows is spread.
    """
    marked = df.withColumn("_block", F.floor(F.col(draw) * blocks).cast("int")).withColumn("_one", F.lit(1).cast("bigint"))
    return running_sum(marked, keys, "_block", [draw, *tie], "_one", out, total).drop("_block", "_one")


def dense_ids(df: DataFrame, order: Sequence[Column], out: str, start: int = 0) -> DataFrame:
    """Gap-free ids in ``order`` over unique rows: range partitions, local positions, partition offsets.

    The range-partitioned rows are checkpointed before their partition numbers are used, so a
    recomputed task cannot see other boundaries. Offsets have one row per partition.
    """
    marked = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mono", F.monotonically_increasing_id())
    )
    fixed = materialize(marked).withColumn("_part", F.shiftright("_mono", 33))
    fixed = fixed.withColumn("_pos", F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))).drop("_mono")
    sizes = fixed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        fixed.join(F.broadcast(offsets), "_part")  # a row for each partition; the ids' rows stay where they are
        .withColumn(out, (F.col("_offset") + F.col("_pos") + start).cast("bigint"))
        .drop("_part", "_pos", "_offset")
    )


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row per key in ``order`` by a partial aggregate, so a heavy key never meets one sort."""
    keys = list(keys)
    order_columns = [F.col(c) if isinstance(c, str) else c for c in order]
    rest = [c for c in df.columns if c not in keys]
    picked = F.min(F.struct(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order_columns)]).alias("_order"),
                            *[F.col(c) for c in rest]))
    return df.groupBy(*keys).agg(picked.alias("_row")).select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns]
    )
