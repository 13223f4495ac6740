"""Governance spaces: labelled transfers and voter participation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small


def space_of_address(space_contracts: DataFrame) -> DataFrame:
    """(address, space) with lower-cased addresses; an address listed in several spaces takes the last by name."""
    return space_contracts.groupBy(F.lower("address").alias("address")).agg(F.max("space").alias("space"))


def label_spaces(transfers: DataFrame, space_contracts: DataFrame) -> DataFrame:
    """Transfers that touch a space contract, with from_label and to_label."""
    spaces = broadcast_if_small(space_of_address(space_contracts))
    for side, label in (("from_address", "from_label"), ("to_address", "to_label")):
        names = spaces.select(F.col("address").alias(side), F.col("space").alias(label))
        transfers = transfers.join(names, side, "left")
    return transfers.filter(F.col("from_label").isNotNull() | F.col("to_label").isNotNull())


def transfers_by_space(labelled: DataFrame) -> DataFrame:
    """One row per (space, transfer): a transfer between two spaces appears in both, within one space once."""
    both = F.array_compact(F.array_distinct(F.array("from_label", "to_label")))
    return labelled.withColumn("space", F.explode(both))


def first_seen(space_transfers: DataFrame) -> DataFrame:
    """(space, address, first_ts): earliest transfer of an address in a space, on either end."""
    ends = F.explode(F.array("from_address", "to_address")).alias("address")
    return (
        space_transfers.select("space", "block_timestamp", ends)
        .filter(F.col("address").isNotNull())
        .groupBy("space", "address")
        .agg(F.min("block_timestamp").alias("first_ts"))
    )


def voters_with_prior_transfer(votes: DataFrame, space_transfers: DataFrame) -> DataFrame:
    """Votes in known spaces plus ``is_user``: the voter moved tokens there at or before the proposal.

    The point-in-time test is an equality join on the first transfer followed by a comparison.
    """
    seen = first_seen(space_transfers)
    known = votes.join(space_transfers.select("space").distinct(), "space", "left_semi")
    joined = known.join(seen.withColumnRenamed("address", "voter"), ["space", "voter"], "left")
    used = F.coalesce(F.col("first_ts") <= F.col("created"), F.lit(False))
    return joined.withColumn("is_user", used).drop("first_ts")


def participation_ratio(marked_votes: DataFrame) -> DataFrame:
    """Per proposal the share of voters, of whales and of others that used the space before; null for an empty group.

    Voters are first reduced to one row per proposal, so a busy proposal is counted from partial sums.
    """
    whale = F.coalesce(F.col("label") == "whales", F.lit(False))
    voters = marked_votes.groupBy("space", "id", "voter").agg(
        F.max(F.col("is_user")).alias("user"), F.max(whale).alias("whale"), F.max(~whale).alias("other")
    )

    def share(group):
        return F.try_divide(F.count_if(group & F.col("user")), F.count_if(group))

    everyone = F.lit(True)
    return voters.groupBy("space", "id").agg(
        share(everyone).alias("voter_user"),
        share(F.col("whale")).alias("whale_user"),
        share(F.col("other")).alias("non_whale_user"),
    )
