"""Transfer tables: contract filtering, edge sums, endpoints."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize


def contract_addresses(contracts: DataFrame) -> DataFrame:
    """Distinct, non-null addresses of the contract dimension."""
    return contracts.select("address").filter(F.col("address").isNotNull()).distinct()


def drop_contract_transfers(transfers: DataFrame, contracts: DataFrame) -> DataFrame:
    """Rows where neither endpoint is a contract; a null endpoint matches nothing and stays.

    Reads only the endpoint columns, so it gives the same edges before or after ``edge_weights``;
    after it, the two anti joins move pair sums instead of raw transfers.
    """
    columns = transfers.columns
    addresses = broadcast_if_small(contract_addresses(contracts))
    for side in ("from_address", "to_address"):
        transfers = transfers.join(addresses.withColumnRenamed("address", side), side, "left_anti")
    return transfers.select(columns)


def keep_sender_in(transfers: DataFrame, wallets: DataFrame) -> DataFrame:
    senders = broadcast_if_small(wallets.select(F.col("address").alias("from_address")))
    return transfers.join(senders, "from_address", "left_semi")


def filter_nonzero(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column) != 0)


def filter_token(transfers: DataFrame, contracts: str | Iterable[str]) -> DataFrame:
    wanted = [contracts] if isinstance(contracts, str) else list(contracts)
    return transfers.filter(F.col("contract_address").isin(wanted))


def hot_wallets(labels: DataFrame) -> DataFrame:
    """Exchange hot wallets: address, name and label."""
    return labels.filter((F.col("label_type") == "cex") & (F.col("label_subtype") == "hot_wallet")).select(
        "address", "address_name", "label"
    )


def edge_weights(transfers: DataFrame) -> DataFrame:
    """USD per (from, to); pairs with a null end are dropped, an all-null pair sums to 0."""
    return (
        transfers.select("from_address", "to_address", "amount_usd")
        .dropna(subset=["from_address", "to_address"])
        .groupBy("from_address", "to_address")
        .agg(F.coalesce(F.sum(F.nanvl("amount_usd", F.lit(None))), F.lit(0.0)).alias("amount_usd"))
    )


def merge_partial_edges(*parts: DataFrame, per_task: int = 1_000_000) -> DataFrame:
    """Final sum over partial edge sums.

    The parts are kept first: one task would else hold the hash tables of all parts and of the merge. They meet in partitions of
    about ``per_task`` rows, so a task's memory does not grow with the table.
    """
    kept = union_all(*[materialize(part) for part in parts])
    spark = kept.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-kept.count() // per_task))
    return edge_weights(kept.repartition(partitions, "from_address", "to_address"))


def union_edges(token: DataFrame, native: DataFrame) -> DataFrame:
    """Token and native edges in one weighted edge list."""
    return merge_partial_edges(token, native)


def union_all(*parts: DataFrame) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def union_distinct(*parts: DataFrame) -> DataFrame:
    return union_all(*parts).distinct()


def transfer_graph(token: DataFrame, native: DataFrame, contracts: DataFrame) -> DataFrame:
    """Edges of both transfer tables without contract traffic and without zero-weight pairs.

    One partial-aggregated shuffle over the raw rows; the anti joins then run on pair sums.
    """
    columns = ["from_address", "to_address", "amount_usd"]
    edges = edge_weights(token.select(columns).unionByName(native.select(columns)))
    return filter_nonzero(drop_contract_transfers(edges, contracts), "amount_usd")


def endpoints(transfers: DataFrame) -> DataFrame:
    """Every sender and receiver, one column, one scan."""
    both = F.explode(F.array("from_address", "to_address")).alias("address")
    return transfers.select(both).filter(F.col("address").isNotNull())


def distinct_endpoints(transfers: DataFrame) -> DataFrame:
    return endpoints(transfers).distinct()


def endpoint_counts(transfers: DataFrame, by: str) -> DataFrame:
    """Exact number of distinct endpoints per ``by``."""
    both = F.explode(F.array("from_address", "to_address")).alias("address")
    return (
        transfers.select(by, both)
        .filter(F.col("address").isNotNull())
        .distinct()
        .groupBy(by)
        .agg(F.count("*").alias("n_addresses"))
    )


def stable_users(users: DataFrame, cex: DataFrame) -> DataFrame:
    """Stablecoin users plus the lower-cased ETH addresses of the exchanges."""
    exchange = cex.filter(F.col("network") == "ETH").select(F.lower("address").alias("address"))
    return union_distinct(users.select("address"), exchange)
