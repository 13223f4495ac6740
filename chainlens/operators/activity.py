"""Hour-of-day activity profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import epoch_hour, epoch_month

HOURS = range(24)
KINDS = ("all", "dst", "non_dst")
# The months counted as daylight-saving months.
DST_FIRST_MONTH, DST_LAST_MONTH = 3, 10


def histogram_columns() -> list[str]:
    return [f"{kind}_{hour}" for kind in KINDS for hour in HOURS]


def hour_histogram(transfers: DataFrame) -> DataFrame:
    """Per sender 24 hourly counts for all, daylight-saving and other months.

    Only the 48 disjoint counters are aggregated (map-side first); the "all" counts are their sums.
    """
    marked = transfers.select(
        "from_address",
        epoch_hour("block_timestamp").alias("_hour"),
        epoch_month("block_timestamp").between(DST_FIRST_MONTH, DST_LAST_MONTH).alias("_dst"),
    ).filter(F.col("from_address").isNotNull())
    counters = []
    for hour in HOURS:
        counters.append(F.expr(f"count_if(_hour = {hour} AND _dst) AS dst_{hour}"))
        counters.append(F.expr(f"count_if(_hour = {hour} AND NOT _dst) AS non_dst_{hour}"))
    counted = marked.groupBy("from_address").agg(*counters)
    totals = [f"dst_{hour} + non_dst_{hour} AS all_{hour}" for hour in HOURS]
    split = [f"{kind}_{hour}" for kind in KINDS[1:] for hour in HOURS]
    return counted.selectExpr("from_address", *totals, *split)


def merge_histograms(*parts: DataFrame) -> DataFrame:
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy("from_address").agg(*[F.expr(f"sum({c}) AS {c}") for c in histogram_columns()])


def normalize_histogram(df: DataFrame) -> DataFrame:
    """Shares within each block of 24; a block without transfers is 0.0 throughout."""
    shares = []
    for kind in KINDS:
        columns = [f"{kind}_{hour}" for hour in HOURS]
        shares += [f"coalesce(try_divide({c}, _{kind}), 0.0D) AS {c}" for c in columns]
    totals = [" + ".join(f"{kind}_{hour}" for hour in HOURS) + f" AS _{kind}" for kind in KINDS]
    return df.selectExpr("*", *totals).selectExpr("from_address", *shares)


def profile_vector(df: DataFrame) -> DataFrame:
    """(address, profile): the 72 shares as one array."""
    return df.select(F.col("from_address").alias("address"), F.array(*histogram_columns()).alias("profile"))
