"""Country evidence: early users of single-country exchanges and name-language records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import epoch_year, year_range
from ..session import broadcast_if_small

MIN_YEAR = 2015


def exchange_addresses(cex: DataFrame, network: str = "ETH") -> DataFrame:
    """(exchange, address) of one network, lower-cased, once each."""
    return (
        cex.filter(F.col("network") == network)
        .select(F.lower("exchange").alias("exchange"), F.lower("address").alias("address"))
        .distinct()
    )


def exchange_years(cex: DataFrame, early_stage: DataFrame, min_year: int = MIN_YEAR) -> DataFrame:
    """(address, country, year) for every year an exchange served one country only."""
    named = early_stage.select(F.lower("exchange_name").alias("exchange"), "country", "latest_year").dropna(
        subset=["exchange"]
    )
    years = year_range(named, min_year, "latest_year")
    return exchange_addresses(cex).join(years, "exchange").select("address", "country", "year")


def early_stage_counterparties(transfers: DataFrame, years: DataFrame) -> DataFrame:
    """The other end of every transfer that touches an exchange address in one of its years.

    A transfer that matches on both ends gives two rows, as a bag union.
    """
    dated = transfers.select("from_address", "to_address", epoch_year("block_timestamp").alias("year"))
    ends = F.array(
        F.struct(F.col("from_address").alias("near"), F.col("to_address").alias("far")),
        F.struct(F.col("to_address").alias("near"), F.col("from_address").alias("far")),
    )
    sides = dated.select("year", F.inline(ends))  # one scan, one join
    near = broadcast_if_small(years).withColumnRenamed("address", "near")
    return sides.join(near, ["near", "year"]).select(F.col("far").alias("address"), "year", "country")


def unique_country_wallets(pairs: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Addresses seen with exactly one country; one partial aggregate of smallest and largest country."""
    if exclude is not None:
        pairs = pairs.join(exclude.select("address"), "address", "left_anti")
    known = pairs.filter(F.col("address").isNotNull() & F.col("country").isNotNull())
    spread = known.groupBy("address").agg(F.min("country").alias("country"), F.max("country").alias("_last"))
    return spread.filter(F.col("country") == F.col("_last")).select("address", "country")


def drop_ambiguous(df: DataFrame, keys: list[str], owner: str) -> DataFrame:
    """Without the owners that have a repeated (keys) pair; an owner with two different pairs stays."""
    repeated = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).select(owner).distinct()
    return df.join(repeated, owner, "left_anti")


def confident_owners(ens_language: DataFrame, countries: DataFrame, floor: float = 0.99) -> DataFrame:
    """(country, address) of confident, unambiguous name records; ``countries`` maps code to name."""
    sure = ens_language.filter(F.col("avg_probs") >= floor)
    clear = drop_ambiguous(sure, ["ens_domain", "owner"], "owner")
    code, name = countries.columns[:2]
    named = clear.join(countries.select(F.col(code).alias("ctry_iso"), F.col(name).alias("country")), "ctry_iso")
    return collect_wallets(named.select("country", F.col("owner").alias("address")))


def collect_wallets(df: DataFrame) -> DataFrame:
    """Distinct (country, address) rows: the map of countries to wallets in long form, whatever a country's size."""
    return df.select("country", "address").distinct()
