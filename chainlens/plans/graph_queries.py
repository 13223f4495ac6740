"""Transfers to weighted graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, relational, transfers
from ..session import materialize
from .registry import Tables, common, query


def edges_of(t: Tables):
    return transfers.transfer_graph(t["token_transfer"], t["native_transfer"], t["contract"])


def graph_of(t: Tables):
    return graph.graph_tables(materialize(edges_of(t)))


common("token_clean", """
    SELECT * FROM token_transfer
    WHERE NOT EXISTS (SELECT 1 FROM contract WHERE address = from_address)
      AND NOT EXISTS (SELECT 1 FROM contract WHERE address = to_address)""")
common("native_clean", """
    SELECT * FROM native_transfer
    WHERE NOT EXISTS (SELECT 1 FROM contract WHERE address = from_address)
      AND NOT EXISTS (SELECT 1 FROM contract WHERE address = to_address)""")
common("all_edge", """
    SELECT from_address, to_address, coalesce(sum(amount_usd), 0) AS amount_usd
    FROM (SELECT from_address, to_address, amount_usd FROM token_clean UNION ALL
          SELECT from_address, to_address, amount_usd FROM native_clean) u
    WHERE from_address IS NOT NULL AND to_address IS NOT NULL GROUP BY 1, 2""")
common("edge", "SELECT * FROM all_edge WHERE amount_usd <> 0")
common("wallet_id", """
    SELECT address, row_number() OVER (ORDER BY address) AS node_id
    FROM (SELECT from_address AS address FROM edge UNION SELECT to_address FROM edge) u""")
common("edge_int", """
    SELECT a.node_id AS src, b.node_id AS dst, amount_usd AS weight
    FROM edge JOIN wallet_id a ON from_address = a.address JOIN wallet_id b ON to_address = b.address""")
common("cdf", """
    SELECT src, dst, w AS weight, sum(w) OVER (PARTITION BY src) AS wsum,
           sum(w) OVER (PARTITION BY src ORDER BY dst ROWS UNBOUNDED PRECEDING) AS cume
    FROM (SELECT src, dst, ln(1 + greatest(weight, 0)) AS w FROM edge_int) x WHERE w > 0""")
common("outdeg", "SELECT src AS node, count(*) AS outdeg, max(wsum) AS wsum FROM cdf GROUP BY src")
common("stable_user", """
    SELECT DISTINCT address FROM (
      SELECT from_address AS address FROM token_transfer WHERE contract_address IN ('k1', 'k2') UNION
      SELECT to_address FROM token_transfer WHERE contract_address IN ('k1', 'k2') UNION
      SELECT lower(address) FROM cex WHERE network = 'ETH') u WHERE address IS NOT NULL""")
common("seed", """
    SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS seed_index
    FROM (SELECT w.node_id FROM stable_user u JOIN wallet_id w ON u.address = w.address
          WHERE w.node_id IN (SELECT node FROM outdeg)) s""")


def stable_users_of(t: Tables):
    stable = transfers.filter_token(t["token_transfer"], ["k1", "k2"])
    return transfers.stable_users(transfers.distinct_endpoints(stable), t["cex"])


def seeds_of(t: Tables, wallets, cdf):
    return graph.seeds(graph.lookup_ids(stable_users_of(t), wallets), graph.out_degree(cdf))


@query("flagship_out_degree", """
    SELECT w.address, o.outdeg, round(o.wsum, 6) AS wsum FROM outdeg o JOIN wallet_id w ON o.node = w.node_id
    ORDER BY o.outdeg DESC, w.address LIMIT 20""")
def flagship(t: Tables):
    wallets, _, cdf = graph_of(t)
    named = graph.out_degree(cdf).join(wallets, F.col("node") == F.col("node_id"))
    ranked = relational.top_n(named, "outdeg", 20, ["address"])
    return ranked.select("address", "outdeg", F.round("wsum", 6).alias("wsum"))


@query("j1_drop_contract_transfers", """
    SELECT from_address, to_address, contract_address, block_timestamp, amount, round(amount_usd, 4) AS amount_usd
    FROM token_clean""")
def _(t):
    kept = transfers.drop_contract_transfers(t["token_transfer"], t["contract"])
    return kept.withColumn("amount_usd", F.round("amount_usd", 4))


@query("j2_keep_sender_in", """
    SELECT from_address, block_timestamp FROM token_transfer
    WHERE from_address IN (SELECT address FROM address_country)""")
def _(t):
    return transfers.keep_sender_in(t["token_transfer"], t["address_country"]).select("from_address", "block_timestamp")


@query("a1_edge_weights", """
    SELECT from_address, to_address, round(coalesce(sum(amount_usd), 0), 4) AS amount_usd FROM token_clean
    WHERE from_address IS NOT NULL AND to_address IS NOT NULL GROUP BY 1, 2""")
def _(t):
    summed = transfers.edge_weights(t["token_transfer"])
    kept = transfers.drop_contract_transfers(summed, t["contract"])
    return kept.select("from_address", "to_address", F.round("amount_usd", 4).alias("amount_usd"))


@query("a2_merge_partial_edges", """
    SELECT from_address, to_address, round(coalesce(sum(amount_usd), 0), 4) AS amount_usd FROM token_transfer
    WHERE from_address IS NOT NULL AND to_address IS NOT NULL GROUP BY 1, 2""")
def _(t):
    transfer = t["token_transfer"]
    parts = [transfers.edge_weights(transfer.filter(part)) for part in ("amount < 25", "amount >= 25")]
    return transfers.merge_partial_edges(*parts).withColumn("amount_usd", F.round("amount_usd", 4))


@query("a3_union_edges", "SELECT from_address, to_address, round(amount_usd, 4) AS amount_usd FROM all_edge")
def _(t):
    token = transfers.drop_contract_transfers(transfers.edge_weights(t["token_transfer"]), t["contract"])
    native = transfers.drop_contract_transfers(transfers.edge_weights(t["native_transfer"]), t["contract"])
    return transfers.union_edges(token, native).withColumn("amount_usd", F.round("amount_usd", 4))


@query("p3_filter_nonzero", "SELECT from_address, to_address, round(amount_usd, 4) AS amount_usd FROM edge")
def _(t):
    return edges_of(t).select("from_address", "to_address", F.round("amount_usd", 4).alias("amount_usd"))


@query("p4_filter_token", """
    SELECT from_address, to_address, contract_address, amount FROM token_transfer WHERE contract_address IN ('k1', 'k2')""")
def _(t):
    return transfers.filter_token(t["token_transfer"], ["k1", "k2"]).select(
        "from_address", "to_address", "contract_address", "amount"
    )


@query("p6_hot_wallets", """
    SELECT address, address_name, label FROM address_label
    WHERE label_type = 'cex' AND label_subtype = 'hot_wallet'""")
def _(t):
    return transfers.hot_wallets(t["address_label"])


@query("a8_distinct_endpoints", """
    SELECT DISTINCT address FROM (SELECT from_address AS address FROM token_transfer UNION ALL
                                  SELECT to_address FROM token_transfer) u WHERE address IS NOT NULL""")
def _(t):
    return transfers.distinct_endpoints(t["token_transfer"])


@query("a8_endpoint_counts", """
    SELECT contract_address, count(DISTINCT address) AS n_addresses
    FROM (SELECT contract_address, from_address AS address FROM token_transfer UNION ALL
          SELECT contract_address, to_address FROM token_transfer) u WHERE address IS NOT NULL GROUP BY 1""")
def _(t):
    return transfers.endpoint_counts(t["token_transfer"], "contract_address")


@query("t7_union_distinct", "SELECT address FROM stable_user")
def _(t):
    return stable_users_of(t)


@query("w2_assign_ids", "SELECT address, node_id FROM wallet_id")
def _(t):
    return graph.wallet_ids(materialize(edges_of(t)))


@query("j3_encode_edges", "SELECT src, dst, round(weight, 4) AS weight FROM edge_int")
def _(t):
    _, encoded, _ = graph_of(t)
    return encoded.withColumn("weight", F.round("weight", 4))


@query("w1_build_cdf", """
    SELECT src, dst, round(weight, 6) AS weight, round(wsum, 6) AS wsum, round(cume, 6) AS cume FROM cdf""")
def _(t):
    _, _, cdf = graph_of(t)
    return cdf.select("src", "dst", *[F.round(c, 6).alias(c) for c in ("weight", "wsum", "cume")])


@query("w1_build_cdf_raw_weight", """
    SELECT src, dst, round(weight, 4) AS weight, round(sum(weight) OVER (PARTITION BY src), 4) AS wsum,
           round(sum(weight) OVER (PARTITION BY src ORDER BY dst ROWS UNBOUNDED PRECEDING), 4) AS cume
    FROM edge_int WHERE weight > 0""")
def _(t):
    _, encoded, _ = graph_of(t)
    cdf = graph.build_cdf(encoded, log=False)
    return cdf.select("src", "dst", *[F.round(c, 4).alias(c) for c in ("weight", "wsum", "cume")])


@query("a4_out_degree", "SELECT node, outdeg, round(wsum, 6) AS wsum FROM outdeg")
def _(t):
    _, _, cdf = graph_of(t)
    return graph.out_degree(cdf).withColumn("wsum", F.round("wsum", 6))


@query("j4_lookup_ids", """
    SELECT w.address, w.node_id FROM stable_user u JOIN wallet_id w ON u.address = w.address""")
def _(t):
    wallets, _, _ = graph_of(t)
    return graph.lookup_ids(stable_users_of(t), wallets)


@query("j5_seeds", "SELECT node_id FROM seed")
def _(t):
    wallets, _, cdf = graph_of(t)
    return seeds_of(t, wallets, cdf)


@query("f13_log_weight", """
    SELECT src, dst, round(ln(1 + greatest(weight, 0)), 6) AS weight FROM edge_int""")
def _(t):
    _, encoded, _ = graph_of(t)
    return encoded.withColumn("weight", F.round(graph.log_weight("weight"), 6))
