"""General filters, checks, set operations and splits over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rng import checking_uniform as sql_uniform
from ..operators import relational, sampling
from .registry import common, query

SEED = 42


@query("p1_select_columns", "SELECT from_address, block_timestamp FROM token_transfer")
def _(t):
    return relational.select_columns(t["token_transfer"], ["from_address", "block_timestamp"])


@query("p2_rename", "SELECT exchange AS cex, address AS from_address, network, website, 'list' AS origin FROM cex")
def _(t):
    return relational.rename(t["cex"], {"exchange": "cex", "address": "from_address"}, origin="list")


@query("p5_filter_isin", """
    SELECT from_address, to_address, amount FROM token_transfer
    WHERE to_address IN (SELECT address FROM contract WHERE address IS NOT NULL)""")
def _(t):
    kept = relational.filter_isin(t["token_transfer"], "to_address", t["contract"].select("address"))
    return kept.select("from_address", "to_address", "amount")


@query("p5_filter_not_in", """
    SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'P')""")
def _(t):
    return relational.filter_isin(t["orders"], "o_orderstatus", ["F", "P"], negate=True).select("o_orderkey", "o_orderstatus")


@query("p9_drop_null_keys", """
    SELECT from_address, amount_usd, to_address FROM (SELECT from_address, to_address, round(amount_usd, 4) AS amount_usd
    FROM token_transfer) t WHERE from_address IS NOT NULL AND amount_usd IS NOT NULL""")
def _(t):
    kept = relational.drop_null_keys(t["token_transfer"], ["from_address", "amount_usd"])
    return kept.select("from_address", F.round("amount_usd", 4).alias("amount_usd"), "to_address")


@query("p16_label_or_other", """
    SELECT c_custkey, CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN c_mktsegment ELSE 'Other' END AS label
    FROM customer""")
def _(t):
    return t["customer"].select("c_custkey", relational.label_or_other("c_mktsegment", ["MACHINERY", "BUILDING"]).alias("label"))


@query("p17_assert_unique", """
    SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def _(t):
    return relational.assert_unique(t["lineitem"], ["l_orderkey", "l_linenumber"])


@query("p18_assert_not_null", """
    SELECT from_address, to_address, block_timestamp FROM token_transfer
    WHERE from_address IS NULL OR to_address IS NULL OR amount_usd IS NULL""")
def _(t):
    broken = relational.assert_not_null(t["token_transfer"], ["from_address", "to_address", "amount_usd"])
    return broken.select("from_address", "to_address", "block_timestamp")


@query("p15_drop_suffix_columns", "SELECT o_orderkey, o_custkey AS customer FROM orders")
def _(t):
    repeated = t["orders"].select(
        "o_orderkey", F.col("o_custkey").alias(" customer "), F.col("o_custkey").alias("customer.1"),
        F.col("o_orderdate").alias("date.2"),
    )
    return relational.drop_suffix_columns(repeated)


@query("t11_sort", "SELECT o_orderpriority, o_orderdate, o_orderkey FROM orders")
def _(t):
    return relational.sort(t["orders"], ["o_orderpriority", "o_orderdate", "o_orderkey"], [True, False, True]).select(
        "o_orderpriority", "o_orderdate", "o_orderkey"
    )


common("doc_draw", f"SELECT doc_id, lang, {sql_uniform('doc_id', '0', SEED)} AS u FROM documents")
common("doc_rank", """
    SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY u, doc_id) AS r,
           count(*) OVER (PARTITION BY lang) AS n FROM doc_draw""")


def _documents(t):
    return t["documents"].select("doc_id", "lang")


@query("w6_capped_split", """
    SELECT doc_id, lang, CASE WHEN r <= 60 THEN 'train' ELSE 'test' END AS split FROM doc_rank WHERE r <= 160""")
def _(t):
    return sampling.capped_split(_documents(t), "lang", "doc_id", 60, 100, SEED, "portable")


@query("w7_stratified_split", """
    SELECT doc_id, lang, CASE WHEN r <= round(n * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM doc_rank""")
def _(t):
    return sampling.stratified_split(_documents(t), "lang", "doc_id", 0.3, SEED, "portable")


@query("w8_stratified_folds", "SELECT doc_id, lang, CAST((r - 1) % 5 AS INTEGER) AS fold FROM doc_rank")
def _(t):
    return sampling.stratified_folds(_documents(t), "lang", "doc_id", 5, SEED, "portable")
