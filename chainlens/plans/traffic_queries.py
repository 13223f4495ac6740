"""Exchange web traffic and search trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational, traffic
from .registry import common, query

LOW, HIGH = "1996-01-01", "2000-12-01"
ALIASES = "CASE country WHEN 'Korea' THEN 'South Korea' ELSE country END"

common("traffic_mean", "SELECT cex, country, avg(traffic) AS traffic FROM traffic GROUP BY 1, 2")
common("traffic_part", f"""
    SELECT cex, {ALIASES} AS country, sum(traffic / total) AS share
    FROM (SELECT *, sum(traffic) OVER (PARTITION BY cex) AS total FROM traffic_mean) m GROUP BY 1, 2""")
common("trend_number", """
    SELECT exchange, country, CASE WHEN trend = '<1' THEN 0 ELSE coalesce(TRY_CAST(trend AS DOUBLE), 0) END AS trend
    FROM trend""")
common("trend_part", """
    SELECT exchange, country, trend / nullif(sum(trend) OVER (PARTITION BY exchange), 0) AS trend FROM trend_number""")
_PLAIN = """trim(regexp_replace(translate(lower({0}), '()', ''), '[ ,.;:|&''"+/-]+', ' ', 'g'))"""
common("named_share", f"""
    SELECT {_PLAIN.format('cex')} AS c_name, {ALIASES} AS country, sum(traffic / total) AS share
    FROM (SELECT *, sum(traffic) OVER (PARTITION BY cex) AS total
          FROM (SELECT cex, country, avg(traffic) AS traffic FROM traffic_named GROUP BY 1, 2) a) m GROUP BY 1, 2""")
common("listed_exchange", f"""
    SELECT exchange, address, {_PLAIN.format('exchange')} AS c_name FROM (
      SELECT DISTINCT lower(address) AS address, CASE lower(exchange) WHEN 'btcturk' THEN 'btcTurk kripto'
        WHEN 'gate.io' THEN 'gate' WHEN 'crypto.com exchange' THEN 'crypto.comexchange' WHEN 'xt' THEN 'xt.com'
        ELSE lower(exchange) END AS exchange
      FROM cex_listed WHERE network = 'ETH') d""")
common("exchange_panel", """
    SELECT exchange, address, country, share AS value
    FROM (SELECT l.*, s.country, s.share, rank() OVER (PARTITION BY l.address ORDER BY l.exchange) AS place
          FROM listed_exchange l JOIN named_share s ON l.c_name = s.c_name) x WHERE place = 1""")


def shares_of(t):
    return traffic.traffic_share(traffic.mean_traffic(t["traffic"]))


def trend_of(t):
    trend = t["trend"].withColumn("trend", relational.to_number("trend"))
    return traffic.trend_share(relational.fill_missing(trend, 0.0, ["trend"]))


def panel_of(t):
    shares = traffic.traffic_share(traffic.mean_traffic(t["traffic_named"]))
    return traffic.match_exchange_traffic(t["cex_listed"], shares)


def flags_of(t):
    return t["china_flag"].withColumn("exchange", F.lower("exchange"))


@query("p7_filter_date_range", f"""
    SELECT cex, date, country, traffic FROM traffic WHERE date >= DATE '{LOW}' AND date < DATE '{HIGH}'""")
def _(t):
    return traffic.filter_date_range(t["traffic"], LOW, HIGH, strict_end=True)


@query("p8_assert_date_coverage", """
    SELECT cex, min(date) AS first_date, max(date) AS last_date FROM traffic GROUP BY cex
    HAVING min(date) <> DATE '1995-01-01' OR max(date) <> DATE '2001-07-01'""")
def _(t):
    return traffic.assert_date_coverage(t["traffic"], "1995-01-01", "2001-07-01", "cex")


@query("j11_merge_on_date", """
    SELECT * FROM (SELECT cex, country, date, traffic FROM traffic WHERE traffic >= 2) a
    UNION ALL
    SELECT cex, country, date, traffic * 10 AS traffic FROM traffic t WHERE NOT EXISTS (
      SELECT 1 FROM traffic f WHERE f.traffic >= 2 AND f.cex = t.cex AND f.country = t.country)""")
def _(t):
    panel = t["traffic"]
    return traffic.merge_on_date([panel.filter("traffic >= 2"), panel.withColumn("traffic", F.col("traffic") * 10)])


@query("a14_mean_traffic", "SELECT cex, country, round(traffic, 6) AS traffic FROM traffic_mean")
def _(t):
    return traffic.mean_traffic(t["traffic"]).withColumn("traffic", F.round("traffic", 6))


@query("a15_traffic_share", "SELECT cex, country, round(share, 6) AS share FROM traffic_part")
def _(t):
    return shares_of(t).withColumn("share", F.round("share", 6))


@query("p13_fill_missing", "SELECT exchange, country, coalesce(trend, '0') AS trend FROM trend")
def _(t):
    return relational.fill_missing(t["trend"], "0", ["trend"])


@query("p14_to_number", """
    SELECT exchange, country, CASE WHEN trend = '<1' THEN 0 ELSE TRY_CAST(trend AS DOUBLE) END AS trend FROM trend""")
def _(t):
    return t["trend"].withColumn("trend", relational.to_number("trend"))


@query("a16_trend_share", "SELECT exchange, country, round(trend, 6) AS trend FROM trend_part")
def _(t):
    return trend_of(t).withColumn("trend", F.round("trend", 6))


@query("j13_match_exchange_traffic", "SELECT exchange, address, country, round(value, 6) AS value FROM exchange_panel")
def _(t):
    return panel_of(t).withColumn("value", F.round("value", 6))


def _mix_sql(pct: float, missing: str) -> str:
    flag = f"coalesce(f.is_china, {missing})"
    return f"""
    SELECT p.exchange, p.address, p.country,
           round(CASE WHEN {flag} THEN p.value * (1 - {pct}::DOUBLE) ELSE p.value END, 6) AS value
    FROM exchange_panel p LEFT JOIN china_flag f ON p.exchange = lower(f.exchange)
    UNION ALL
    SELECT DISTINCT p.exchange, p.address, 'China', CASE WHEN {flag} THEN {pct}::DOUBLE ELSE 0.0 END
    FROM exchange_panel p LEFT JOIN china_flag f ON p.exchange = lower(f.exchange)"""


def _mix_query(name, pct, missing):
    @query(name, _mix_sql(pct, str(missing).lower()))
    def _(t):
        return traffic.china_mix(panel_of(t), flags_of(t), pct, missing).withColumn("value", F.round("value", 6))


_mix_query("f19_china_mix_50", 0.5, True)
_mix_query("f19_china_mix_90", 0.9, True)
_mix_query("f19_china_mix_50_known_only", 0.5, False)


@query("a26_cex_traffic_multiple", "SELECT country, round(avg(value), 6) AS value FROM exchange_panel GROUP BY 1")
def _(t):
    return traffic.cex_traffic_summary(panel_of(t), "multiple").withColumn("value", F.round("value", 6))


@query("a26_cex_traffic_pooling", """
    SELECT country, round(sum(value), 6) AS value FROM (
      SELECT exchange, country, min(value) AS value FROM exchange_panel GROUP BY 1, 2) x GROUP BY 1""")
def _(t):
    return traffic.cex_traffic_summary(panel_of(t), "pooling").withColumn("value", F.round("value", 6))


@query("t1_top_n", """
    SELECT country, round(avg(value), 6) AS value FROM exchange_panel GROUP BY 1
    ORDER BY round(avg(value), 6) DESC, country LIMIT 20""")
def _(t):
    summary = traffic.cex_traffic_summary(panel_of(t), "multiple").withColumn("value", F.round("value", 6))
    return relational.top_n(summary, "value", 20, ["country"])


COUNTRIES = sorted([f"NATION_{i}" for i in range(25) if i not in (3, 4)] + ["South Korea", "Korea"])
_WIDE = ", ".join(f"sum(traffic) FILTER (country = '{c}') AS \"{c}\"" for c in COUNTRIES)
common("traffic_wide", f"SELECT cex, date, {_WIDE} FROM traffic GROUP BY 1, 2")


def wide_of(t):
    return relational.pivot(t["traffic"], ["cex", "date"], "country", COUNTRIES, "traffic")


@query("t10_pivot_fixed_axis", "SELECT * FROM traffic_wide")
def _(t):
    return wide_of(t)


@query("t9_melt", f"""
    SELECT cex, date, country, traffic FROM traffic_wide
    UNPIVOT INCLUDE NULLS (traffic FOR country IN ({', '.join(f'"{c}"' for c in COUNTRIES)}))""")
def _(t):
    return relational.melt(wide_of(t), ["cex", "date"], COUNTRIES, "country", "traffic")


@query("t2_top_columns_by_mean", "SELECT country AS name, round(avg(traffic), 6) AS mean FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS country, \"{c}\" AS traffic FROM traffic_wide" for c in COUNTRIES)
    + ") x GROUP BY 1 ORDER BY avg(traffic) DESC, country LIMIT 5")
def _(t):
    return relational.top_columns_by_mean(wide_of(t), COUNTRIES, 5).withColumn("mean", F.round("mean", 6))


@query("p12_replace_values", f"SELECT cex, {ALIASES} AS country, sum(traffic) AS traffic FROM traffic GROUP BY 1, 2")
def _(t):
    renamed = relational.replace_values(t["traffic"], "country", traffic.COUNTRY_ALIASES)
    return renamed.groupBy("cex", "country").agg(F.sum("traffic").alias("traffic"))


@query("p12_replace_from_table", """
    SELECT o.ens_domain, coalesce(c.name, o.ctry_iso) AS ctry_iso
    FROM ens_language o LEFT JOIN lang_country c ON o.ctry_iso = c.code""")
def _(t):
    return relational.replace_values(t["ens_language"], "ctry_iso", t["lang_country"]).select("ens_domain", "ctry_iso")


@query("t8_common_keys", """
    SELECT DISTINCT exchange FROM trend WHERE exchange IN (SELECT exchange FROM cex WHERE network = 'ETH')""")
def _(t):
    return relational.common_keys(t["trend"].select("exchange"), t["cex"].filter("network = 'ETH'").select("exchange"))


@query("t8_new_keys", """
    SELECT DISTINCT exchange FROM trend WHERE exchange NOT IN (SELECT exchange FROM cex WHERE network = 'ETH')""")
def _(t):
    return relational.new_keys(t["trend"].select("exchange"), t["cex"].filter("network = 'ETH'").select("exchange"))
