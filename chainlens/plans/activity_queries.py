"""Hour-of-day profiles and date parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import activity
from .registry import common, query


def _histogram_sql(source: str) -> str:
    counters = []
    for hour in activity.HOURS:
        at = f"(block_timestamp // 3600) % 24 = {hour}"
        dst = "month(make_timestamp(block_timestamp * 1000000)) BETWEEN 3 AND 10"
        counters += [
            f"count(*) FILTER ({at}) AS all_{hour}",
            f"count(*) FILTER ({at} AND {dst}) AS dst_{hour}",
            f"count(*) FILTER ({at} AND NOT {dst}) AS non_dst_{hour}",
        ]
    return f"SELECT from_address, {', '.join(counters)} FROM {source} WHERE from_address IS NOT NULL GROUP BY 1"


COLUMNS = activity.histogram_columns()
common("token_hours", _histogram_sql("token_transfer"))
common("native_hours", _histogram_sql("native_transfer"))
common("hours", f"""
    SELECT from_address, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in COLUMNS)}
    FROM (SELECT * FROM token_hours UNION ALL BY NAME SELECT * FROM native_hours) u GROUP BY 1""")
common("profile", "SELECT from_address, " + ", ".join(
    f"coalesce({kind}_{h} / nullif({' + '.join(f'{kind}_{x}' for x in activity.HOURS)}, 0), 0.0) AS {kind}_{h}"
    for kind in activity.KINDS for h in activity.HOURS) + " FROM hours")


def histogram_of(t):
    return activity.merge_histograms(
        activity.hour_histogram(t["token_transfer"]), activity.hour_histogram(t["native_transfer"])
    )


def profile_of(t):
    return activity.normalize_histogram(histogram_of(t))


@query("a5_hour_histogram", "SELECT * FROM token_hours")
def _(t):
    return activity.hour_histogram(t["token_transfer"])


@query("a6_merge_histograms", "SELECT * FROM hours")
def _(t):
    return histogram_of(t)


@query("a7_normalize_histogram",
       "SELECT from_address, " + ", ".join(f"round({c}, 6) AS {c}" for c in COLUMNS) + " FROM profile")
def _(t):
    return profile_of(t).select("from_address", *[F.round(c, 6).alias(c) for c in COLUMNS])


@query("f10_epoch_parts", """
    SELECT year(s) AS year, month(s) AS month, hour(s) AS hour, count(*) AS n
    FROM (SELECT make_timestamp(block_timestamp * 1000000) AS s FROM token_transfer) x GROUP BY 1, 2, 3""")
def _(t):
    parts = t["token_transfer"].select(
        dates.epoch_year("block_timestamp").cast("bigint").alias("year"),
        dates.epoch_month("block_timestamp").cast("bigint").alias("month"),
        dates.epoch_hour("block_timestamp").cast("bigint").alias("hour"),
    )
    return parts.groupBy("year", "month", "hour").agg(F.count("*").alias("n"))


@query("f11_to_date", """
    SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(ts AS DATE) END AS day FROM events""")
def _(t):
    text = F.when(F.col("event_type") == "error", F.lit("no date")).otherwise(F.col("ts").cast("string"))
    return t["events"].select("event_id", dates.parse_date(text).alias("day"))


@query("f12_year_range", """
    SELECT exchange_name, country, CAST(unnest(range(1995, CAST(latest_year AS BIGINT))) AS INTEGER) AS year
    FROM early_stage WHERE latest_year > 1995""")
def _(t):
    return dates.year_range(t["early_stage"], 1995, "latest_year")
