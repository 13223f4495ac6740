"""Date parts of epoch seconds by calendar arithmetic, so no session time zone can shift them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def epoch_date(seconds: Column | str) -> Column:
    days = F.floor(_column(seconds) / F.lit(86400)).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


def epoch_year(seconds: Column | str) -> Column:
    return F.year(epoch_date(seconds))


def epoch_month(seconds: Column | str) -> Column:
    return F.month(epoch_date(seconds))


def epoch_hour(seconds: Column | str) -> Column:
    """UTC hour of day."""
    return F.pmod(F.floor(_column(seconds) / F.lit(3600)), F.lit(24)).cast("int")


def parse_date(text: Column | str, fmt: str | None = None) -> Column:
    """Date from text; null where it does not parse."""
    value = _column(text)
    return F.try_to_timestamp(value, F.lit(fmt)).cast("date") if fmt else F.try_to_timestamp(value).cast("date")


def year_range(df: DataFrame, min_year: int, latest_year: str, out: str = "year") -> DataFrame:
    """One row per year from ``min_year`` up to but not including ``latest_year``; none when it is null."""
    latest = F.col(latest_year).cast("int")
    return (
        df.filter(latest > min_year)
        .withColumn(out, F.explode(F.sequence(F.lit(min_year), latest - 1)))
        .drop(latest_year)
    )
