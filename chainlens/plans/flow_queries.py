"""Flows between countries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flows, relational, transfers
from .registry import common, query

AXIS = [f"NATION_{i}" for i in range(25)]

common("flow_labelled", """
    SELECT t.*, a.country AS from_country, b.country AS to_country FROM token_transfer t
    LEFT JOIN address_country a ON t.from_address = a.address LEFT JOIN address_country b ON t.to_address = b.address""")
common("flow", """
    SELECT from_country, to_country, sum(amount) AS amount, coalesce(sum(amount_usd), 0) AS amount_usd FROM flow_labelled
    WHERE from_country IS NOT NULL AND to_country IS NOT NULL GROUP BY 1, 2""")
common("native_flow", """
    SELECT a.country AS from_country, b.country AS to_country, sum(amount) AS amount, coalesce(sum(amount_usd), 0) AS amount_usd
    FROM native_transfer t JOIN address_country a ON t.from_address = a.address
    JOIN address_country b ON t.to_address = b.address GROUP BY 1, 2""")
common("pair_flow", """
    SELECT from_country AS source, to_country AS target, sum(amount_usd) AS amount_usd
    FROM (SELECT * FROM flow UNION ALL SELECT * FROM native_flow) u GROUP BY 1, 2""")
common("net_pair", """
    SELECT f.source, f.target, f.amount_usd - coalesce(b.amount_usd, 0) AS amount_usd
    FROM pair_flow f LEFT JOIN pair_flow b ON f.source = b.target AND f.target = b.source
    WHERE f.source <> f.target AND f.amount_usd > coalesce(b.amount_usd, 0)
      AND f.source IN (SELECT target FROM pair_flow) AND f.target IN (SELECT source FROM pair_flow)""")


def token_flow_of(t):
    return flows.flow_between(t["token_transfer"], t["address_country"])


def pairs_of(t):
    native = flows.flow_between(t["native_transfer"], t["address_country"])
    return flows.flow_share(token_flow_of(t), native)


@query("j8_label_flow", """
    SELECT from_address, to_address, block_timestamp, amount, from_country, to_country FROM flow_labelled""")
def _(t):
    return flows.label_flow(t["token_transfer"], t["address_country"]).select(
        "from_address", "to_address", "block_timestamp", "amount", "from_country", "to_country"
    )


@query("a9_country_flows", """
    SELECT from_country, to_country, round(amount, 4) AS amount, round(amount_usd, 4) AS amount_usd FROM flow""")
def _(t):
    return token_flow_of(t).select(
        "from_country", "to_country", F.round("amount", 4).alias("amount"), F.round("amount_usd", 4).alias("amount_usd")
    )


@query("a10_flow_share", """
    SELECT source, target, round(amount_usd, 4) AS amount_usd,
           round(amount_usd / sum(amount_usd) OVER () * 100, 2) AS amount_usd_pct FROM pair_flow""")
def _(t):
    return pairs_of(t).withColumn("amount_usd", F.round("amount_usd", 4))


def _outflow_sql(missing: str) -> str:
    fill = (lambda c: f"coalesce({c}, 0)") if missing == "zero" else (lambda c: c)
    return f"""
    SELECT coalesce(o.country, i.country) AS country, round({fill('o.v')} - {fill('i.v')}, 4) AS net_outflow_usd
    FROM (SELECT source AS country, sum(amount_usd) AS v FROM pair_flow GROUP BY 1) o
    FULL JOIN (SELECT target AS country, sum(amount_usd) AS v FROM pair_flow GROUP BY 1) i ON o.country = i.country"""


@query("a11_net_outflow", _outflow_sql("null"))
def _(t):
    return flows.net_outflow(pairs_of(t)).withColumn("net_outflow_usd", F.round("net_outflow_usd", 4))


@query("a11_net_outflow_zero", _outflow_sql("zero"))
def _(t):
    return flows.net_outflow(pairs_of(t), "zero").withColumn("net_outflow_usd", F.round("net_outflow_usd", 4))


@query("a12_bilateral_net_flow", "SELECT source, target, round(amount_usd, 4) AS amount_usd FROM net_pair")
def _(t):
    return flows.bilateral_net_flow(pairs_of(t)).withColumn("amount_usd", F.round("amount_usd", 4))


_CELLS = ", ".join(f"round(coalesce(sum(amount_usd) FILTER (target = '{c}'), 0), 4) AS \"{c}\"" for c in sorted(AXIS))


@query("a13_flow_matrix", f"SELECT source, {_CELLS} FROM net_pair GROUP BY source")
def _(t):
    matrix = flows.flow_matrix(flows.bilateral_net_flow(pairs_of(t)), AXIS)
    return matrix.select("source", *[F.round(c, 4).alias(c) for c in sorted(AXIS)])


_RAW_CELLS = ", ".join(f"round(coalesce(sum(amount_usd) FILTER (target = '{c}'), 0), 4) AS \"{c}\"" for c in AXIS)


@query("t10_pivot", f"SELECT source, {_RAW_CELLS} FROM pair_flow GROUP BY source")
def _(t):
    wide = relational.pivot(pairs_of(t), ["source"], "target", AXIS, "amount_usd", 0.0)
    return wide.select("source", *[F.round(c, 4).alias(c) for c in AXIS])


@query("t6_union_all", """
    SELECT from_country, to_country, round(amount_usd, 4) AS amount_usd
    FROM (SELECT * FROM flow UNION ALL SELECT * FROM native_flow) u""")
def _(t):
    native = flows.flow_between(t["native_transfer"], t["address_country"])
    both = transfers.union_all(token_flow_of(t), native)
    return both.select("from_country", "to_country", F.round("amount_usd", 4).alias("amount_usd"))


@query("a23_value_share", """
    SELECT country, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM address_country), 6) AS share
    FROM address_country GROUP BY country""")
def _(t):
    return relational.value_share(t["address_country"], "country").withColumn("share", F.round("share", 6))


@query("j19_map_index", """
    SELECT a.c_custkey, CASE WHEN a.c_nationkey = 7 THEN 'South Korea' ELSE n.n_name END AS name
    FROM customer a LEFT JOIN nation n ON a.c_nationkey = n.n_nationkey""")
def _(t):
    indexed = t["customer"].select("c_custkey", "c_nationkey")
    named = relational.map_index(indexed, "c_nationkey", t["nation"].select("n_nationkey", "n_name"), {7: "South Korea"})
    return named.select("c_custkey", "name")
