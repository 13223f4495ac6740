"""Country evidence and governance participation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import activity, dao, ens, evidence, relational
from .activity_queries import COLUMNS, profile_of
from .graph_queries import edges_of
from .registry import common, query

MIN_YEAR = 1995
TARGETED = ["NATION_1", "NATION_3", "NATION_5"]

common("exchange_address", """
    SELECT DISTINCT lower(exchange) AS exchange, lower(address) AS address FROM cex WHERE network = 'ETH'""")
common("exchange_year", f"""
    SELECT a.address, e.country, unnest(range({MIN_YEAR}, CAST(e.latest_year AS BIGINT))) AS year
    FROM exchange_address a JOIN early_stage e ON a.exchange = lower(e.exchange_name) WHERE e.latest_year > {MIN_YEAR}""")
common("early_pair", " UNION ALL ".join(f"""
    SELECT t.{far} AS address, y.year, y.country
    FROM {table} t JOIN exchange_year y ON t.{near} = y.address
     AND year(make_timestamp(t.block_timestamp * 1000000)) = y.year"""
    for table in ("token_transfer", "native_transfer")
    for near, far in (("from_address", "to_address"), ("to_address", "from_address"))))
common("early_unique", """
    SELECT address, min(country) AS country FROM early_pair
    WHERE address IS NOT NULL AND address NOT IN (SELECT address FROM exchange_year) GROUP BY address
    HAVING count(DISTINCT country) = 1""")
common("clear_owner", """
    SELECT * FROM ens_language WHERE avg_probs >= 0.99 AND owner NOT IN (
      SELECT owner FROM ens_language WHERE avg_probs >= 0.99 GROUP BY ens_domain, owner HAVING count(*) > 1)""")
common("owner_country", """
    SELECT DISTINCT c.name AS country, o.owner AS address FROM clear_owner o JOIN lang_country c ON o.ctry_iso = c.code""")


def years_of(t):
    return evidence.exchange_years(t["cex"], t["early_stage"], MIN_YEAR)


def pairs_of(t):
    years = years_of(t)
    return evidence.early_stage_counterparties(t["token_transfer"], years).unionByName(
        evidence.early_stage_counterparties(t["native_transfer"], years)
    )


def unique_of(t):
    return evidence.unique_country_wallets(pairs_of(t), years_of(t))


def owners_of(t):
    return evidence.confident_owners(t["ens_language"], t["lang_country"])


@query("p10_dedup", """
    SELECT exchange, min(address) AS address FROM exchange_address GROUP BY exchange""")
def _(t):
    return relational.dedup(evidence.exchange_addresses(t["cex"]), ["exchange"], ["address"]).select("exchange", "address")


@query("p10_dedup_keep_first", """
    SELECT o_custkey, o_orderkey, o_orderstatus FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def _(t):
    first = relational.dedup(t["orders"], ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return first.select("o_custkey", "o_orderkey", "o_orderstatus")


@query("j6_exchange_years", "SELECT address, country, CAST(year AS INTEGER) AS year FROM exchange_year")
def _(t):
    return years_of(t)


@query("j7_early_stage_counterparties", """
    SELECT address, CAST(year AS INTEGER) AS year, country, count(*) AS n FROM early_pair GROUP BY 1, 2, 3""")
def _(t):
    return pairs_of(t).groupBy("address", "year", "country").agg(F.count("*").alias("n"))


@query("a19_unique_country_wallets", "SELECT address, country FROM early_unique")
def _(t):
    return unique_of(t)


@query("j15_intersect_keys", """
    SELECT address, country FROM early_unique WHERE address IN (SELECT address FROM wallet_id)""")
def _(t):
    from ..operators.transfers import distinct_endpoints

    return relational.intersect_keys(unique_of(t), distinct_endpoints(edges_of(t)), "address")


@query("p11_drop_ambiguous", """
    SELECT ens_domain, owner, ctry_iso FROM ens_language WHERE owner NOT IN (
      SELECT owner FROM ens_language GROUP BY ens_domain, owner HAVING count(*) > 1)""")
def _(t):
    kept = evidence.drop_ambiguous(t["ens_language"], ["ens_domain", "owner"], "owner")
    return kept.select("ens_domain", "owner", "ctry_iso")


@query("a20_collect_wallets", "SELECT country, address FROM owner_country")
def _(t):
    return owners_of(t)


@query("f8_ens_owner", """
    SELECT created_at, name, coalesce(wrapped_owner_id, owner_id) AS resolved_owner FROM ens_domain
    WHERE name <> '' AND coalesce(wrapped_owner_id, owner_id) IS NOT NULL""")
def _(t):
    return ens.ens_owner(_nested(t)).select("created_at", "name", "resolved_owner")


def _nested(t):
    flat = t["ens_domain"]

    def ref(column):
        return F.when(F.col(column).isNotNull(), F.struct(F.col(column).alias("id")))

    return flat.select("created_at", "name", ref("owner_id").alias("owner"), ref("wrapped_owner_id").alias("wrappedOwner"))


@query("a21_last_wins", """
    SELECT name, coalesce(wrapped_owner_id, owner_id) AS resolved_owner FROM ens_domain
    WHERE name <> '' AND coalesce(wrapped_owner_id, owner_id) IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY created_at DESC) = 1""")
def _(t):
    return ens.last_wins(ens.ens_owner(_nested(t)), "name", "resolved_owner", ["created_at"])


common("ground_truth", """
    SELECT address, country, 'ens' AS origin FROM owner_country UNION ALL
    SELECT address, country, 'early' AS origin FROM early_unique""")


@query("j16_assemble_features", f"""
    SELECT g.address, g.origin, CASE WHEN g.country IN ('NATION_1', 'NATION_3', 'NATION_5') THEN g.country ELSE 'Other' END AS label,
           {', '.join(f'round(w.embedding[{i + 1}], 6) AS f_{i}' for i in range(64))},
           {', '.join(f'round(p.{c}, 6) AS f_{64 + i}' for i, c in enumerate(COLUMNS))}
    FROM ground_truth g JOIN wallet_vector w ON g.address = w.wallet JOIN profile p ON g.address = p.from_address""")
def _(t):
    from ..operators.learn import assemble_features

    features = assemble_features(
        owners_of(t), unique_of(t), t["wallet_vector"].select(F.col("wallet").alias("address"), "embedding"),
        activity.profile_vector(profile_of(t)), TARGETED,
    )
    return features.select("address", "origin", "label",
                           *[F.round(F.get("features", F.lit(i)), 6).alias(f"f_{i}") for i in range(136)])


common("space_of", "SELECT lower(address) AS address, max(space) AS space FROM space_contract GROUP BY 1")
common("space_labelled", """
    SELECT t.from_address, t.to_address, t.block_timestamp, t.amount, a.space AS from_label, b.space AS to_label
    FROM token_transfer t LEFT JOIN space_of a ON t.from_address = a.address LEFT JOIN space_of b ON t.to_address = b.address
    WHERE a.space IS NOT NULL OR b.space IS NOT NULL""")
common("space_transfer", """
    SELECT from_label AS space, * FROM space_labelled WHERE from_label IS NOT NULL
    UNION ALL SELECT to_label AS space, * FROM space_labelled
    WHERE to_label IS NOT NULL AND to_label IS DISTINCT FROM from_label""")
common("space_seen", """
    SELECT space, address, min(block_timestamp) AS first_ts FROM (
      SELECT space, from_address AS address, block_timestamp FROM space_transfer UNION ALL
      SELECT space, to_address, block_timestamp FROM space_transfer) u WHERE address IS NOT NULL GROUP BY 1, 2""")
common("vote_marked", """
    SELECT v.*, coalesce(s.first_ts <= v.created, false) AS is_user
    FROM proposal_vote v LEFT JOIN space_seen s ON v.space = s.space AND v.voter = s.address
    WHERE v.space IN (SELECT space FROM space_transfer)""")


def space_transfers_of(t):
    return dao.transfers_by_space(dao.label_spaces(t["token_transfer"], t["space_contract"]))


@query("j9_label_spaces", "SELECT from_address, to_address, block_timestamp, from_label, to_label FROM space_labelled")
def _(t):
    return dao.label_spaces(t["token_transfer"], t["space_contract"]).select(
        "from_address", "to_address", "block_timestamp", "from_label", "to_label"
    )


@query("j10_transfers_by_space", "SELECT space, from_address, to_address, block_timestamp FROM space_transfer")
def _(t):
    return space_transfers_of(t).select("space", "from_address", "to_address", "block_timestamp")


@query("j14_voters_with_prior_transfer", "SELECT space, id, voter, label, is_user FROM vote_marked")
def _(t):
    marked = dao.voters_with_prior_transfer(t["proposal_vote"], space_transfers_of(t))
    return marked.select("space", "id", "voter", "label", "is_user")


@query("a22_participation_ratio", """
    SELECT space, id, round(count(DISTINCT voter) FILTER (is_user) / count(DISTINCT voter), 6) AS voter_user,
      round(count(DISTINCT voter) FILTER (is_user AND w) / nullif(count(DISTINCT voter) FILTER (w), 0), 6) AS whale_user,
      round(count(DISTINCT voter) FILTER (is_user AND NOT w) / nullif(count(DISTINCT voter) FILTER (NOT w), 0), 6) AS non_whale_user
    FROM (SELECT *, coalesce(label = 'whales', false) AS w FROM vote_marked) v GROUP BY 1, 2""")
def _(t):
    ratio = dao.participation_ratio(dao.voters_with_prior_transfer(t["proposal_vote"], space_transfers_of(t)))
    return ratio.select("space", "id", *[F.round(c, 6).alias(c) for c in ("voter_user", "whale_user", "non_whale_user")])
