"""Integer-keyed wallet graph: ids, encoded edges, cumulative weights, degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize
from .ranking import dense_ids, running_sum
from .transfers import endpoints


def assign_ids(addresses: DataFrame, start: int = 1) -> DataFrame:
    """Distinct addresses with a gap-free id in address order."""
    unique = addresses.select("address").filter(F.col("address").isNotNull()).distinct()
    return dense_ids(unique, [F.col("address")], "node_id", start)


def wallet_ids(edges: DataFrame) -> DataFrame:
    """Ids for every endpoint of an edge list."""
    return assign_ids(endpoints(edges))


def encode_edges(edges: DataFrame, wallets: DataFrame) -> DataFrame:
    """Text-keyed edges as (src, dst, weight)."""
    source = wallets.select(F.col("address").alias("from_address"), F.col("node_id").alias("src"))
    target = wallets.select(F.col("address").alias("to_address"), F.col("node_id").alias("dst"))
    return (
        edges.join(source, "from_address")
        .join(target, "to_address")
        .select("src", "dst", F.col("amount_usd").alias("weight"))
    )


def lookup_ids(addresses: DataFrame, wallets: DataFrame) -> DataFrame:
    return addresses.select("address").join(wallets, "address")


def seeds(listed: DataFrame, out_degrees: DataFrame) -> DataFrame:
    """Listed wallets that have out-edges."""
    return listed.select("node_id").join(
        out_degrees.select(F.col("node").alias("node_id")), "node_id", "left_semi"
    )


def log_weight(weight: Column | str) -> Column:
    """ln(1 + max(w, 0))."""
    return F.ln(F.lit(1.0) + positive_weight(weight))


def positive_weight(weight: Column | str) -> Column:
    column = F.col(weight) if isinstance(weight, str) else weight
    return F.greatest(column, F.lit(0.0))


def wide_sources(edges: DataFrame, max_fanout: int) -> DataFrame:
    """Sources with more than ``max_fanout`` out-edges: at most edges / max_fanout rows."""
    return edges.groupBy("src").agg(F.count("*").alias("_n")).filter(F.col("_n") > max_fanout).select("src")


def hub_blocks(hubs: DataFrame, max_fanout: int) -> DataFrame:
    """``hubs`` (src, dst, ...) with ``block``: ranges of ids are gathered by the edges before them, not by their ids.

    A range is half a block wide, as is the stretch of positions in which the ranges of one block start, so a block holds
    at most ``max_fanout`` edges, and a hub has two blocks for every ``max_fanout`` edges at most, however far apart its
    neighbours are.
    """
    half = max(1, max_fanout // 2)
    ranged = hubs.withColumn("_range", F.floor(F.col("dst") / F.lit(half)).cast("bigint"))
    before = Window.partitionBy("src").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counted = ranged.groupBy("src", "_range").agg(F.count("*").alias("_n"))
    starts = counted.select("src", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    starts = materialize(starts.select("src", "_range", F.floor(F.col("_start") / F.lit(half)).cast("bigint").alias("block")))
    return ranged.join(broadcast_if_small(starts), ["src", "_range"]).drop("_range")


def build_cdf(edges: DataFrame, log: bool = True, max_fanout: int = 65536) -> DataFrame:
    """Per source: total weight and cumulative weight in order of ``dst``.

    Sources above ``max_fanout`` edges are cut into blocks of consecutive neighbours, at most ``max_fanout`` each, so no
    task ever sorts a whole hub. ``block`` is the number of the block (0 for all other sources).
    """
    weight = log_weight("weight") if log else positive_weight("weight")
    kept = edges.select("src", "dst", weight.alias("weight")).filter(F.col("weight") > 0)
    wide = materialize(wide_sources(kept, max_fanout))
    any_wide = not wide.isEmpty()
    narrow = kept.join(broadcast_if_small(wide), "src", "left_anti") if any_wide else kept
    whole = Window.partitionBy("src").orderBy("dst")
    found = narrow.select(
        "src", "dst", "weight",
        F.sum("weight").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("wsum"),
        F.sum("weight").over(whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("cume"),
        F.lit(0).cast("bigint").alias("block"),
    )
    if not any_wide:
        return found
    hubs = hub_blocks(kept.join(broadcast_if_small(wide), "src"), max_fanout)
    summed = running_sum(hubs, ["src"], "block", ["dst"], "weight", "cume", total="wsum")
    return found.unionByName(summed.select("src", "dst", "weight", "wsum", "cume", "block"))


def out_degree(cdf: DataFrame) -> DataFrame:
    return cdf.groupBy(F.col("src").alias("node")).agg(
        F.count("*").alias("outdeg"), F.max("wsum").alias("wsum")
    )


def graph_tables(edges: DataFrame, log: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(wallets, integer edges, cdf); the integer edges are materialized because the cdf reads them twice."""
    wallets = wallet_ids(edges)
    encoded = materialize(encode_edges(edges, wallets))
    return wallets, encoded, build_cdf(encoded, log)
