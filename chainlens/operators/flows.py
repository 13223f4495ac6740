"""Flows between countries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize


def label_flow(transfers: DataFrame, address_country: DataFrame) -> DataFrame:
    """Country of sender and receiver; unknown addresses stay with a null country."""
    address_country = broadcast_if_small(address_country.select("address", "country"))
    for side, label in (("from_address", "from_country"), ("to_address", "to_country")):
        named = address_country.select(F.col("address").alias(side), F.col("country").alias(label))
        transfers = transfers.join(named, side, "left")
    return transfers


def sum_pairs(transfers: DataFrame) -> DataFrame:
    """Amount and USD per (from_address, to_address): what country sums need of the raw transfers."""
    return transfers.groupBy("from_address", "to_address").agg(*[F.sum(c).alias(c) for c in ("amount", "amount_usd")])


def country_flows(labelled: DataFrame) -> DataFrame:
    """Amount and USD per (from_country, to_country), unknown countries left out."""
    known = labelled.dropna(how="any", subset=["from_country", "to_country"])
    return known.groupBy("from_country", "to_country").agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("amount", "amount_usd")]
    )


def flow_between(transfers: DataFrame, address_country: DataFrame) -> DataFrame:
    """``country_flows`` of raw transfers, which meet the countries of senders and receivers and are summed at once.

    Sums per pair of addresses would be as many as the transfers where pairs hardly repeat: one shuffle more for nothing.
    Transfers with an unknown end leave with the first join that finds it.
    """
    needed = transfers.select("from_address", "to_address", "amount", "amount_usd").dropna(subset=["from_address", "to_address"])
    return country_flows(label_flow(needed, address_country.dropna(subset=["address", "country"])))


def flow_share(*flows: DataFrame) -> DataFrame:
    """(source, target, amount_usd, amount_usd_pct) over the union of the tokens' flows."""
    merged = flows[0]
    for flow in flows[1:]:
        merged = merged.unionByName(flow)
    summed = merged.groupBy(F.col("from_country").alias("source"), F.col("to_country").alias("target")).agg(
        F.sum("amount_usd").alias("amount_usd")
    )
    summed = materialize(summed)  # a row for each pair of countries, read twice
    total = summed.agg(F.sum("amount_usd")).scalar()
    return summed.withColumn("amount_usd_pct", F.round(F.col("amount_usd") / total * 100, 2))


def net_outflow(flows: DataFrame, missing: str = "null") -> DataFrame:
    """Outflow minus inflow per country; a country on one side only is null, or counts as zero there."""
    if missing not in ("null", "zero"):
        raise ValueError("missing must be null or zero")
    legs = F.explode(
        F.array(
            F.struct(F.col("source").alias("country"), F.col("amount_usd").alias("out"), F.lit(None).cast("double").alias("in")),
            F.struct(F.col("target").alias("country"), F.lit(None).cast("double").alias("out"), F.col("amount_usd").alias("in")),
        )
    )
    sides = flows.select(legs.alias("leg")).select("leg.*").filter(F.col("country").isNotNull())
    sums = sides.groupBy("country").agg(F.sum("out").alias("out"), F.sum("in").alias("in"))
    if missing == "zero":
        sums = sums.fillna(0.0, subset=["out", "in"])
    return sums.select("country", (F.col("out") - F.col("in")).alias("net_outflow_usd"))


def bilateral_net_flow(flows: DataFrame) -> DataFrame:
    """A to B minus B to A where positive, for countries that occur both as source and as target."""
    summed = flows.filter(F.col("source").isNotNull() & F.col("target").isNotNull()).groupBy("source", "target").agg(
        F.sum("amount_usd").alias("amount_usd")
    )
    both = summed.select("source").intersect(summed.select(F.col("target").alias("source")))
    pairs = summed.join(both, "source", "left_semi").join(
        both.withColumnRenamed("source", "target"), "target", "left_semi"
    )
    # Each pair under one unordered key with a sign, so an absent direction needs no outer join.
    signed = pairs.filter(F.col("source") != F.col("target")).select(
        F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"),
        F.when(F.col("source") < F.col("target"), F.col("amount_usd")).otherwise(-F.col("amount_usd")).alias("net"),
    )
    net = signed.groupBy("a", "b").agg(F.sum("net").alias("net")).filter(F.col("net") != 0)
    forward = F.col("net") > 0
    return net.select(
        F.when(forward, F.col("a")).otherwise(F.col("b")).alias("source"),
        F.when(forward, F.col("b")).otherwise(F.col("a")).alias("target"),
        F.abs("net").alias("amount_usd"),
    )


def flow_matrix(net: DataFrame, countries: list[str]) -> DataFrame:
    """Dense source x target table on a fixed, sorted axis; empty cells are 0.0."""
    axis = sorted(countries)
    wide = net.groupBy("source").pivot("target", axis).agg(F.sum("amount_usd"))
    return wide.fillna(0.0, subset=axis)
