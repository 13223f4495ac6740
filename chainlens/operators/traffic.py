"""Exchange web traffic and search trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CEX_TRAFFIC_NAMES, CEX_TREND_NAMES, clean_name
from .evidence import exchange_addresses
from .ranking import first_by
from .relational import replace_values

# The country alias merged into one name.
COUNTRY_ALIASES = {"Korea": "South Korea"}


def filter_date_range(df: DataFrame, low: str, high: str, column: str = "date", strict_end: bool = False) -> DataFrame:
    """Inclusive date range; ``strict_end`` leaves the last day out."""
    first, last = F.lit(low).cast("date"), F.lit(high).cast("date")
    before = F.col(column) < last if strict_end else F.col(column) <= last
    return df.filter((F.col(column) >= first) & before)


def assert_date_coverage(df: DataFrame, low: str, high: str, group: str, column: str = "date") -> DataFrame:
    """Groups whose first or last date is not the bound; empty when every group covers the range."""
    ends = df.groupBy(group).agg(F.min(column).alias("first_date"), F.max(column).alias("last_date"))
    return ends.filter(
        (F.col("first_date") != F.lit(low).cast("date")) | (F.col("last_date") != F.lit(high).cast("date"))
    )


def merge_on_date(panels: list[DataFrame]) -> DataFrame:
    """Long (cex, country, date, traffic) of several files; a country is taken whole from the first file that has it."""
    ranked = [panel.select("cex", "country", "date", "traffic", F.lit(i).alias("_file")) for i, panel in enumerate(panels)]
    merged = ranked[0]
    for panel in ranked[1:]:
        merged = merged.unionByName(panel)
    owner = merged.groupBy("cex", "country").agg(F.min("_file").alias("_file"))
    return merged.join(owner, ["cex", "country", "_file"]).drop("_file")


def first_file_wins(long: DataFrame) -> DataFrame:
    """Long (cex, file, country, date, traffic) rows without the countries that an earlier file of the exchange has."""
    owner = long.groupBy("cex", "country").agg(F.min("file").alias("file"))
    return long.join(owner, ["cex", "country", "file"]).drop("file")


def mean_traffic(panel: DataFrame) -> DataFrame:
    """Mean per (cex, country); missing values are skipped."""
    return panel.groupBy("cex", "country").agg(F.avg(F.nanvl("traffic", F.lit(None))).alias("traffic"))


def traffic_share(means: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Share of each country in its exchange's total; aliases are merged after dividing."""
    totals = means.groupBy("cex").agg(F.sum("traffic").alias("_total"))
    shares = means.join(totals, "cex").select(
        "cex", "country", F.try_divide("traffic", "_total").alias("share")
    )
    renamed = replace_values(shares, "country", COUNTRY_ALIASES if aliases is None else aliases)
    return renamed.groupBy("cex", "country").agg(F.sum("share").alias("share"))


def trend_share(trend: DataFrame) -> DataFrame:
    """(exchange, country, trend) with the numeric trend divided by its exchange's total."""
    totals = trend.groupBy("exchange").agg(F.sum("trend").alias("_total"))
    return trend.join(totals, "exchange").select(
        "exchange", "country", F.try_divide("trend", "_total").alias("trend")
    )


def name_trend(trend: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Trend rows under the names of the address list: ``aliases`` (list name to trend name) read backwards."""
    known = CEX_TREND_NAMES if aliases is None else aliases
    return replace_values(trend, "exchange", {name: listed for listed, name in known.items()})


def join_trend_similarity(trend: DataFrame, similarity: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Similarities beside the trends of their exchange, whose names may differ from the address list's."""
    return name_trend(trend, aliases).join(similarity, "exchange").dropna()


def country_score(joined: DataFrame) -> DataFrame:
    """Mean of trend times similarity per (wallet, country)."""
    return joined.groupBy("wallet", "country").agg(F.avg(F.col("trend") * F.col("similarity")).alias("score"))


def match_exchange_traffic(cex: DataFrame, shares: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(exchange, address, country, value): exchanges whose cleaned name equals a traffic name.

    Names of the address list are replaced by ``aliases`` first. Only an exact match counts, so the name comparison is an
    equality join on the cleaned names. An address listed under several exchanges with traffic keeps the first of
    them by name; one without traffic does not stand in the way.
    """
    renamed = replace_values(exchange_addresses(cex), "exchange", CEX_TRAFFIC_NAMES if aliases is None else aliases)
    named = renamed.distinct().withColumn("c_name", clean_name("exchange"))
    traffic = shares.select(clean_name("cex").alias("c_name"), "country", F.col("share").alias("value"))
    known = named.join(traffic.select("c_name").distinct(), "c_name", "left_semi")
    owner = first_by(known, ["address"], ["exchange"])
    return owner.join(traffic, "c_name").select("exchange", "address", "country", "value")


def china_mix(panel: DataFrame, flags: DataFrame, pct: float, missing_flag: bool = True, country: str = "China") -> DataFrame:
    """Scale flagged exchanges by 1 - pct and add a ``country`` row of pct (0 when not flagged) per address.

    ``missing_flag`` says how an exchange absent from the flag table counts.
    """
    flagged = panel.join(flags.select("exchange", "is_china"), "exchange", "left").withColumn(
        "is_china", F.coalesce("is_china", F.lit(missing_flag))
    )
    scaled = flagged.withColumn(
        "value", F.when(F.col("is_china"), F.col("value") * (1 - pct)).otherwise(F.col("value"))
    ).drop("is_china")
    added = flagged.select("exchange", "address", "is_china").distinct().select(
        "exchange", "address", F.lit(country).alias("country"),
        F.when(F.col("is_china"), F.lit(pct)).otherwise(F.lit(0.0)).alias("value"),
    )
    return scaled.select("exchange", "address", "country", "value").unionByName(added)


def cex_traffic_summary(panel: DataFrame, mode: str = "multiple") -> DataFrame:
    """Per country the mean over addresses, or the sum over one row per (exchange, country)."""
    if mode == "multiple":
        return panel.groupBy("country").agg(F.avg("value").alias("value"))
    if mode != "pooling":
        raise ValueError("mode must be multiple or pooling")
    once = first_by(panel, ["exchange", "country"], ["address"])
    return once.groupBy("country").agg(F.sum("value").alias("value"))
