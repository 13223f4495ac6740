"""Input views over the given tables, written once and read by Spark SQL and by the checking engine.

Two shorthands hide the dialect differences: ``EPOCH(col)`` (seconds since 1970 of a zone-less
timestamp), ``SERIES(lo, hi)`` (one row per integer) and ``DOUBLES(col)`` (array of doubles).
"""

from __future__ import annotations

import re

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    "token_transfer": """
        SELECT CASE WHEN l_orderkey % 997 = 0 THEN NULL ELSE 'c' || o_custkey END AS from_address,
               CASE WHEN l_linenumber = 5 THEN 'p' || l_partkey ELSE 's' || l_suppkey END AS to_address,
               'k' || (l_partkey % 5) AS contract_address,
               EPOCH(l_shipdate) + (l_orderkey * 7 + l_linenumber) % 24 * 3600 + l_linenumber * 60 AS block_timestamp,
               l_quantity AS amount,
               CASE WHEN l_linenumber = 7 THEN 0 WHEN l_linenumber = 6 THEN NULL
                    ELSE l_extendedprice * (1 - l_discount) END AS amount_usd
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R'""",
    "native_transfer": """
        SELECT 's' || l_suppkey AS from_address, 'c' || o_custkey AS to_address,
               EPOCH(l_shipdate) + (l_orderkey * 5 + l_linenumber) % 24 * 3600 AS block_timestamp,
               l_quantity AS amount, l_extendedprice * (1 - l_discount) AS amount_usd
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'""",
    "contract": """
        SELECT 's' || s_suppkey AS address, s_name AS name FROM supplier WHERE s_acctbal < 600
        UNION ALL SELECT 's' || s_suppkey AS address, s_name AS name FROM supplier WHERE s_acctbal < 0
        UNION ALL SELECT CAST(NULL AS VARCHAR(8)) AS address, max(s_name) AS name FROM supplier""",
    "cex": """
        SELECT 'Exch-' || s_nationkey AS exchange, upper('s' || s_suppkey) AS address,
               CASE WHEN s_acctbal > 8000 THEN 'BTC' ELSE 'ETH' END AS network, s_name AS website FROM supplier
        UNION ALL
        SELECT 'EXCH-' || s_nationkey AS exchange, 's' || s_suppkey AS address, 'ETH' AS network, s_name AS website
        FROM supplier WHERE s_acctbal > 5000""",
    "cex_listed": """
        SELECT CASE lower(exchange) WHEN 'exch-7' THEN 'Gate.io' WHEN 'exch-8' THEN 'BtcTurk' WHEN 'exch-9' THEN 'XT'
                    WHEN 'exch-10' THEN 'Crypto.com Exchange' ELSE exchange END AS exchange, address, network, website FROM cex
        UNION ALL
        SELECT 'A (no) traffic' AS exchange, 's' || s_suppkey AS address, 'ETH' AS network, s_name AS website
        FROM supplier WHERE s_suppkey % 3 = 0
        UNION ALL
        SELECT 'Exch-2' AS exchange, 's' || s_suppkey AS address, 'ETH' AS network, s_name AS website
        FROM supplier WHERE s_suppkey % 4 = 0""",
    "traffic_named": """
        SELECT CASE cex WHEN 'Exch-7' THEN 'Gate' WHEN 'Exch-8' THEN 'BTCTurk - Kripto' WHEN 'Exch-9' THEN 'XT.com'
                    WHEN 'Exch-10' THEN 'crypto.(com)exchange' ELSE cex END AS cex, date, country, traffic FROM traffic""",
    "early_stage": """
        SELECT 'EXCH-' || n_nationkey AS exchange_name, n_name AS country,
               CASE WHEN n_nationkey = 4 THEN NULL ELSE 1995 + n_nationkey % 6 END AS latest_year FROM nation""",
    "address_label": """
        SELECT 's' || s_suppkey AS address, s_name AS address_name, 'Exch-' || s_nationkey AS label,
               CASE WHEN s_suppkey % 2 = 0 THEN 'cex' ELSE 'dex' END AS label_type,
               CASE WHEN s_suppkey % 4 = 0 THEN 'hot_wallet' ELSE 'deposit_wallet' END AS label_subtype FROM supplier""",
    "address_country": """
        SELECT 'c' || c_custkey AS address, n_name AS country
        FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0
        UNION ALL
        SELECT 's' || s_suppkey AS address, n_name AS country
        FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal >= 1000""",
    "traffic": """
        SELECT 'Exch-' || (o_custkey % 30) AS cex, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
               CASE n_name WHEN 'NATION_3' THEN 'South Korea' WHEN 'NATION_4' THEN 'Korea' ELSE n_name END AS country,
               CAST(count(*) AS DOUBLE) AS traffic
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3""",
    "trend": """
        SELECT 'Exch-' || (c_custkey % 30) AS exchange, n_name AS country,
               CASE WHEN n_name = 'NATION_9' THEN NULL WHEN count(*) < 2 THEN '<1'
                    ELSE CAST(count(*) AS VARCHAR(20)) END AS trend
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        GROUP BY 'Exch-' || (c_custkey % 30), n_name""",
    "ens_domain": """
        SELECT page_id AS created_at, CASE WHEN page_id % 13 = 5 THEN '' ELSE regexp_extract(url, '//([^/]+)', 1) END AS name,
               CASE WHEN page_id % 9 = 4 THEN NULL ELSE 'c' || (page_id % 40) END AS owner_id,
               CASE WHEN page_id % 3 = 0 THEN 'c' || (page_id % 17) ELSE NULL END AS wrapped_owner_id FROM pages""",
    "ens_language": """
        SELECT 'd' || k AS ens_domain, 'c' || (k % 500) AS owner, lang AS ctry_iso,
               CASE WHEN doc_id % 4 = 1 THEN CAST(0.95 AS DOUBLE) ELSE CAST(0.995 AS DOUBLE) END AS avg_probs
        FROM (SELECT doc_id, lang, CASE WHEN doc_id % 30 = 3 THEN doc_id - 3 ELSE doc_id END AS k FROM documents) d""",
    "lang_country": """
        SELECT lang AS code, 'NATION_' || (min(doc_id) % 25) AS name FROM documents WHERE lang <> 'es' GROUP BY lang""",
    "ens_name": """
        SELECT page_id, CASE page_id % 7 WHEN 0 THEN host || '.eth' WHEN 1 THEN '[' || md5(host) || '].addr.reverse'
                             WHEN 2 THEN 'reverse' WHEN 3 THEN upper(md5(host)) WHEN 4 THEN '[x]' || host || '].eth'
                             WHEN 5 THEN host || '.eth.eth' ELSE host || '.addr.reverse.eth' END AS name
        FROM (SELECT page_id, regexp_extract(url, '//([^/]+)', 1) AS host FROM pages) p""",
    "space_contract": """
        SELECT 'sp' || (s_suppkey % 8) AS space, upper('s' || s_suppkey) AS address FROM supplier WHERE s_acctbal >= 0
        UNION ALL
        SELECT 'sp' || (s_suppkey % 5) AS space, 's' || s_suppkey AS address FROM supplier WHERE s_acctbal >= 7000""",
    "proposal_vote": """
        SELECT 'sp' || (o_orderkey % 40 % 8) AS space, 'p' || (o_orderkey % 40) AS id,
               EPOCH(o_orderdate) * 0 + (9496 + o_orderkey % 40 * 30) * 86400 AS created, 'c' || o_custkey AS voter,
               CASE WHEN o_orderpriority LIKE '1%' THEN 'whales' WHEN o_orderpriority LIKE '2%' THEN NULL
                    ELSE 'small' END AS label FROM orders""",
    "wallet_vector": """
        SELECT 'c' || vec_id AS wallet, DOUBLES(embedding) AS embedding, 'NATION_' || label AS country FROM embeddings""",
    "anchor": """
        SELECT 's' || vec_id AS address, 'Exch-' || (vec_id % 25) AS exchange, DOUBLES(embedding) AS embedding FROM embeddings""",
    "anchor_country": """
        SELECT a.address, a.exchange, s.country, s.value
        FROM anchor a JOIN (
            SELECT t.cex, t.country, t.traffic / u.total AS value
            FROM (SELECT cex, country, sum(traffic) AS traffic FROM traffic GROUP BY cex, country) t
            JOIN (SELECT cex, sum(traffic) AS total FROM traffic GROUP BY cex) u ON t.cex = u.cex) s ON a.exchange = s.cex""",
    "china_flag": """
        SELECT 'Exch-' || s_nationkey AS exchange, max(s_acctbal) > 9000 AS is_china
        FROM supplier WHERE s_acctbal > 3000 GROUP BY s_nationkey""",
    "prediction": """
        SELECT id, 'NATION_' || label AS label, 'NATION_' || k AS class,
               CAST((id * 3 + k * 7) % 10 + 1 + CASE WHEN k = label THEN 3 ELSE 0 END AS DOUBLE) / 58 AS p
        FROM (SELECT vec_id AS id, label, SERIES(0, 9) AS k FROM embeddings) e""",
    "attribution": """
        SELECT sample, class, feature, CAST((sample * 13 + feature * 29 + class * 5) % 101 - 50 AS DOUBLE) / 100 AS value
        FROM (SELECT sample, class, SERIES(0, 135) AS feature
              FROM (SELECT vec_id AS sample, SERIES(0, 2) AS class FROM embeddings) c) f""",
    "token_vector": """
        SELECT vec_id % 50 AS text_id, vec_id AS token_id,
               CASE WHEN vec_id % 4 = 0 OR vec_id % 50 = 7 THEN 0 ELSE 1 END AS mask,
               DOUBLES(embedding) AS embedding FROM embeddings""",
    "graded_part": """
        SELECT p_partkey AS id, p_size AS size, p_partkey % 10 AS digit, CAST(p_retailprice AS DOUBLE) AS price,
               CASE WHEN p_size <= 13 THEN 'small' WHEN p_size <= 33 THEN CASE WHEN p_partkey % 10 <= 4 THEN 'mid low' ELSE 'mid high' END
                    WHEN p_partkey % 10 <= 4 THEN 'large low' ELSE 'large high' END AS label
        FROM part WHERE p_size <= 13 OR p_size BETWEEN 17 AND 33 OR p_size >= 37""",
    "spaced_part": """
        SELECT id, size, digit, label FROM graded_part
        WHERE size <= 13 OR (size >= 37 AND (digit <= 3 OR digit >= 6))""",
    "text_line": """
        SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '  ' || source || '  ' WHEN doc_id % 3 = 1 THEN lang ELSE '   ' END AS line
        FROM documents""",
}

_SPARK = (
    (r"EPOCH\((\w+)\)", r"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', \1)"),
    (r"SERIES\((\d+), (\d+)\)", r"explode(sequence(\1, \2))"),
    (r"DOUBLES\((\w+)\)", r"CAST(\1 AS ARRAY<DOUBLE>)"),
    (r"VARCHAR\(\d+\)", "STRING"),
)
_DUCK = (
    (r"EPOCH\((\w+)\)", r"CAST(epoch(\1) AS BIGINT)"),
    (r"SERIES\((\d+), (\d+)\)", r"unnest(range(\1, \2 + 1))"),
    (r"DOUBLES\((\w+)\)", r"CAST(\1 AS DOUBLE[])"),
)


def _translate(text: str, rules) -> str:
    for pattern, replacement in rules:
        text = re.sub(pattern, replacement, text)
    return text.strip()


def spark_text(name: str) -> str:
    return _translate(VIEWS[name], _SPARK)


def duck_text(name: str) -> str:
    return _translate(VIEWS[name], _DUCK)


def sources_of(text: str, known) -> list[str]:
    """Names after FROM or JOIN that are in ``known``, in order of appearance."""
    found = re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text)
    return list(dict.fromkeys(name for name in found if name in known))
