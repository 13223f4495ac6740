"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return edges.select(F.explode(ends).alias("e")).select("e.u", "e.v")


def _stars_only(edges: DataFrame) -> bool:
    """Whether every node is either a centre or linked to one centre alone."""
    roles = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")),
    )).alias("r")).select("r.*")
    counts = roles.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
    return not counts.where("leaf + centre > 1").limit(1).count()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (columns u, v); the component is its smallest id.

    A large star hangs each larger neighbour of a node on the node's smallest neighbour; the minimum per node is pre-added
    in the map tasks and written, so that the skew join can split a hub's edges. A small star does the same for the
    smaller neighbours. The loop ends when only stars are left. Steps are checkpointed.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .distinct())
    while not _stars_only(edges):
        around = _both_ways(edges)
        lowest = materialize(around.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = around.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(smallest, "u").select(F.explode(hung).alias("e")).select("e.u", "e.v")
        edges = materialize(small.where("u <> v").distinct())
    hubs = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(hubs)
