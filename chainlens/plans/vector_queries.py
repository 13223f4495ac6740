"""Similarity, anchors and country scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector_math
from ..operators import vectors
from .registry import common, query
from .traffic_queries import trend_of

common("anchor_key", "SELECT address AS key, exchange, embedding AS vector FROM anchor")
common("exchange_mean", """
    SELECT exchange AS key, list(m ORDER BY i) AS vector FROM (
      SELECT exchange, i, avg(x) AS m FROM (
        SELECT exchange, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM anchor) e
      GROUP BY exchange, i) g GROUP BY exchange""")
common("wallet_anchor", """
    SELECT w.wallet AS id, a.key, a.exchange, list_cosine_similarity(w.embedding, a.vector) AS score
    FROM wallet_vector w CROSS JOIN anchor_key a""")
common("wallet_exchange", """
    SELECT w.wallet AS id, a.key, list_cosine_similarity(w.embedding, a.vector) AS score
    FROM wallet_vector w CROSS JOIN exchange_mean a""")
common("country_score_sum", """
    SELECT s.id, c.country AS key, sum(s.score * c.value) AS score
    FROM wallet_anchor s JOIN anchor_country c ON s.key = c.address GROUP BY 1, 2""")
common("country_prob_soft", """
    SELECT id, key AS country, exp(score - max(score) OVER (PARTITION BY id))
      / sum(exp(score - m)) OVER (PARTITION BY id) AS prob
    FROM (SELECT *, max(score) OVER (PARTITION BY id) AS m FROM country_score_sum) x""")
common("neighbour_pair", """
    SELECT w.wallet, a.embedding AS a, w.embedding AS b FROM wallet_vector w JOIN anchor a
    ON substr(a.address, 2) = substr(w.wallet, 2)
    UNION ALL
    SELECT w.wallet, v.embedding AS a, w.embedding AS b FROM wallet_vector w JOIN wallet_vector v
    ON CAST(substr(v.wallet, 2) AS BIGINT) = CAST(substr(w.wallet, 2) AS BIGINT) + 1""")


def wallets_of(t):
    return vectors.as_vectors(t["wallet_vector"], "wallet")


def anchors_of(t):
    return vectors.anchor_multiple(t["anchor_country"], t["anchor"])


def means_of(t):
    return vectors.anchor_mean(t["anchor_country"], t["anchor"])


def exchange_axis(t):
    return vectors.as_vectors(vectors.country_mean_vector(t["anchor"], "exchange"), "exchange", "key")


def _pairs(t):
    wallet = t["wallet_vector"].withColumn("n", F.substring("wallet", 2, 20).cast("bigint"))
    anchor = t["anchor"].select(F.substring("address", 2, 20).cast("bigint").alias("n"), F.col("embedding").alias("a"))
    later = wallet.select((F.col("n") - 1).alias("n"), F.col("embedding").alias("a"))
    return wallet.select("wallet", "n", F.col("embedding").alias("b")).join(anchor.unionByName(later), "n")


def _similarity_query(name, function, expression):
    @query(name, f"SELECT wallet, round({expression}, 6) AS score FROM neighbour_pair")
    def _(t):
        return _pairs(t).select("wallet", F.round(function("a", "b"), 6).alias("score"))


_similarity_query("f14_cosine_similarity", vector_math.cosine_similarity, "list_cosine_similarity(a, b)")
_similarity_query("f15_inverse_euclidean", vector_math.inverse_euclidean, "1 / nullif(list_distance(a, b), 0)")
_similarity_query("f16_inverse_quadratic", vector_math.inverse_quadratic, "pow(1 / nullif(list_distance(a, b), 0), 2)")


@query("f17_l2_normalize", """
    SELECT wallet, i, round(x / sqrt(list_inner_product(embedding, embedding)), 6) AS x FROM (
      SELECT wallet, embedding, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM wallet_vector) e""")
def _(t):
    unit = t["wallet_vector"].select("wallet", F.posexplode(vector_math.l2_normalize("embedding")).alias("i", "x"))
    return unit.select("wallet", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


@query("f18_one_hot", """
    SELECT c_custkey, i AS hour, CASE WHEN i = c_nationkey THEN 1 ELSE 0 END AS flag
    FROM (SELECT c_custkey, c_nationkey, unnest(range(0, 25)) AS i FROM customer) x""")
def _(t):
    flags = t["customer"].select("c_custkey", F.posexplode(vector_math.one_hot("c_nationkey", 25)).alias("hour", "flag"))
    return flags.withColumn("hour", F.col("hour").cast("bigint"))


@query("t4_argmax_array", """
    SELECT wallet, list_position(embedding, list_max(embedding)) - 1 AS at FROM wallet_vector""")
def _(t):
    return t["wallet_vector"].select("wallet", vector_math.argmax("embedding").cast("int").alias("at"))


@query("w10_softmax_array", """
    SELECT wallet, unnest(range(0, len(embedding))) AS i, round(unnest(list_transform(embedding, lambda x: exp(x - list_max(embedding))
      / list_sum(list_transform(embedding, lambda y: exp(y - list_max(embedding)))))), 9) AS p FROM wallet_vector""")
def _(t):
    soft = t["wallet_vector"].select("wallet", F.posexplode(vector_math.softmax_array("embedding")).alias("i", "p"))
    return soft.select("wallet", F.col("i").cast("bigint").alias("i"), F.round("p", 9).alias("p"))


@query("a27_country_mean_vector", """
    SELECT country, i, round(avg(x), 6) AS x FROM (
      SELECT country, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM wallet_vector) e GROUP BY 1, 2""")
def _(t):
    means = vectors.country_mean_vector(t["wallet_vector"], "country")
    return means.select("country", F.posexplode("embedding").alias("i", "x")).select(
        "country", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x")
    )


@query("a28_masked_mean", """
    SELECT text_id, i, round(sum(x * mask) / greatest(sum(mask), 1e-9), 6) AS x FROM (
      SELECT text_id, mask, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM token_vector) e
    GROUP BY 1, 2""")
def _(t):
    means = vectors.masked_mean(t["token_vector"], "text_id", "mask")
    return means.select("text_id", F.posexplode("embedding").alias("i", "x")).select(
        "text_id", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x")
    )


@query("j17_cross_similarity", """
    SELECT w.wallet AS id, a.key, round(1 / nullif(list_distance(w.embedding, a.vector), 0), 6) AS score
    FROM wallet_vector w CROSS JOIN exchange_mean a""")
def _(t):
    scored = vectors.cross_similarity(wallets_of(t), exchange_axis(t), "inverse_euclidean")
    return scored.withColumn("score", F.round("score", 6))


@query("v3_emb_cos_sim", "SELECT id, key, round(score, 6) AS score FROM wallet_exchange")
def _(t):
    return vectors.emb_cos_sim(wallets_of(t), exchange_axis(t)).withColumn("score", F.round("score", 6))


def _elements(joined):
    """A row for each element of the vector."""
    spread = joined.select("key", "country", F.round("value", 6).alias("value"), F.posexplode("vector").alias("i", "x"))
    return spread.withColumns({"i": F.col("i").cast("bigint"), "x": F.round("x", 6)})


@query("v1_anchor_multiple", """
    SELECT address AS key, country, round(value, 6) AS value, unnest(range(0, len(embedding))) AS i, round(unnest(embedding), 6) AS x
    FROM (SELECT c.*, a.embedding FROM anchor_country c JOIN anchor a ON c.address = a.address) x""")
def _(t):
    anchors, values = anchors_of(t)
    joined = values.join(anchors, "key")
    return _elements(joined)


@query("v2_anchor_mean", """
    SELECT m.key, v.country, round(v.value, 6) AS value, unnest(range(0, len(m.vector))) AS i, round(unnest(m.vector), 6) AS x
    FROM exchange_mean m JOIN (SELECT exchange, country, avg(value) AS value FROM anchor_country GROUP BY 1, 2) v
    ON m.key = v.exchange""")
def _(t):
    anchors, values = means_of(t)
    joined = values.join(anchors, "key")
    return _elements(joined)


@query("v4_country_prob", "SELECT id, key, round(score, 6) AS score FROM country_score_sum")
def _(t):
    return vectors.country_prob(wallets_of(t), *anchors_of(t)).withColumn("score", F.round("score", 6))


@query("v5_wallet_country", "SELECT id, country, round(prob, 6) AS prob FROM country_prob_soft")
def _(t):
    return vectors.wallet_country(wallets_of(t), *anchors_of(t)).withColumn("prob", F.round("prob", 6))


@query("v5_wallet_country_mean_anchor", """
    SELECT id, key AS country, round(exp(score) / sum(exp(score)) OVER (PARTITION BY id), 6) AS prob FROM (
      SELECT s.id, c.country AS key, sum(s.score * c.value) AS score FROM wallet_exchange s
      JOIN (SELECT exchange, country, avg(value) AS value FROM anchor_country GROUP BY 1, 2) c ON s.key = c.exchange
      GROUP BY 1, 2) x""")
def _(t):
    return vectors.wallet_country(wallets_of(t), *means_of(t)).withColumn("prob", F.round("prob", 6))


@query("v6_weighted_country", """
    SELECT s.id, c.country AS key, round(sum(s.score * c.value) / max(t.total), 4) + 0.0 AS score
    FROM wallet_anchor s JOIN anchor_country c ON s.key = c.address
    JOIN (SELECT id, sum(score) AS total FROM wallet_anchor GROUP BY id) t ON s.id = t.id GROUP BY 1, 2""")
def _(t):
    return vectors.weighted_country(wallets_of(t), *anchors_of(t)).withColumn("score", F.round("score", 4) + 0.0)  # no -0.0


@query("v7_reweight_inverse_frequency", """
    SELECT address AS key, country, round(w / sum(w) OVER (PARTITION BY address), 6) AS value FROM (
      SELECT address, country, value / (avg(value) OVER (PARTITION BY country) + 1e-12) AS w FROM anchor_country) x""")
def _(t):
    _, values = anchors_of(t)
    return vectors.reweight_inverse_frequency(values).withColumn("value", F.round("value", 6))


@query("v8_similarity_matrix", """
    SELECT a.key AS id, b.key, round(list_cosine_similarity(a.vector, b.vector), 6) AS score
    FROM exchange_mean a CROSS JOIN exchange_mean b""")
def _(t):
    return vectors.similarity_matrix(exchange_axis(t)).withColumn("score", F.round("score", 6))


@query("m6_nearest", """
    SELECT id, key, round(score, 6) AS score FROM wallet_exchange
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, id) <= 10""")
def _(t):
    return vectors.nearest(wallets_of(t), exchange_axis(t), 10).withColumn("score", F.round("score", 6))


@query("a25_mean_country_prob", "SELECT country, round(avg(prob), 6) AS prob FROM country_prob_soft GROUP BY country")
def _(t):
    from ..operators.metrics import mean_country_prob

    probs = vectors.wallet_country(wallets_of(t), *anchors_of(t))
    return mean_country_prob(probs).withColumn("prob", F.round("prob", 6))


@query("a17_exchange_similarity", "SELECT id AS wallet, exchange, round(avg(score), 6) AS similarity FROM wallet_anchor GROUP BY 1, 2")
def _(t):
    members = t["anchor"].select(F.col("address").alias("key"), F.col("exchange").alias("group"), F.col("embedding").alias("vector"))
    scored = vectors.mean_scores_by_group(wallets_of(t), members)
    return scored.select(F.col("id").alias("wallet"), F.col("group").alias("exchange"), F.round("score", 6).alias("similarity"))


@query("w10_softmax_by", """
    SELECT id, key, round(exp(score / 0.1) / sum(exp(score / 0.1)) OVER (PARTITION BY id), 6) AS p FROM wallet_exchange""")
def _(t):
    scored = vectors.emb_cos_sim(wallets_of(t), exchange_axis(t))
    return vectors.softmax_by(scored, ["id"], "score", "p", tau=0.1).select("id", "key", F.round("p", 6).alias("p"))


@query("w11_standardize", """
    SELECT id, key, round((score - low) / nullif(sum(score - low) OVER (PARTITION BY id), 0), 6) AS p
    FROM (SELECT *, min(score) OVER (PARTITION BY id) AS low FROM wallet_exchange) x""")
def _(t):
    scored = vectors.emb_cos_sim(wallets_of(t), exchange_axis(t))
    return vectors.standardize(scored, ["id"], "score", "p").select("id", "key", F.round("p", 6).alias("p"))


def _trend_sql(kind, mode):
    similarity = {
        "cosine": "list_cosine_similarity(w.embedding, a.vector)",
        "inverse_euclidean": "1 / nullif(list_distance(w.embedding, a.vector), 0)",
        "inverse_quadratic": "pow(1 / nullif(list_distance(w.embedding, a.vector), 0), 2)",
    }[kind]
    source = "anchor_key" if mode == "multiple" else "exchange_mean"
    exchange = "a.exchange" if mode == "multiple" else "a.key"
    return f"""
      SELECT s.wallet, t.country, avg(t.trend * s.similarity) AS score
      FROM (SELECT w.wallet, {exchange} AS exchange, avg({similarity}) AS similarity
            FROM wallet_vector w CROSS JOIN {source} a GROUP BY 1, 2) s
      JOIN trend_part t ON t.exchange = s.exchange
      WHERE t.trend IS NOT NULL AND s.similarity IS NOT NULL GROUP BY 1, 2"""


_NORMALIZERS = {
    "softmax": "exp(score / 0.1) / sum(exp(score / 0.1)) OVER (PARTITION BY wallet)",
    "standardize": "(score - low) / nullif(sum(score - low) OVER (PARTITION BY wallet), 0)",
}


def _score_query(kind, mode, normalizer):
    @query(f"v9_score_{mode}_{kind}_{normalizer}", f"""
        SELECT wallet, country, round(score, 6) AS score, round({_NORMALIZERS[normalizer]}, 6) AS norm_score
        FROM (SELECT *, min(score) OVER (PARTITION BY wallet) AS low FROM ({_trend_sql(kind, mode)}) r) x""")
    def _(t):
        ranked = vectors.score_wallets(wallets_of(t), t["anchor"], trend_of(t), kind, normalizer, mode)
        return ranked.select("wallet", "country", F.round("score", 6).alias("score"), F.round("norm_score", 6).alias("norm_score"))


for _kind in vector_math.SIMILARITIES:
    for _mode in ("multiple", "mean"):
        for _normalizer in _NORMALIZERS:
            _score_query(_kind, _mode, _normalizer)


@query("v9_top_countries", f"""
    SELECT wallet, country, round(score, 6) AS score FROM ({_trend_sql('cosine', 'mean')}) r
    QUALIFY row_number() OVER (PARTITION BY wallet ORDER BY score DESC, country) <= 5""")
def _(t):
    ranked = vectors.score_wallets(wallets_of(t), t["anchor"], trend_of(t), "cosine", "softmax", "mean", 5)
    return ranked.select("wallet", "country", F.round("score", 6).alias("score"))


@query("j12_join_trend_similarity", """
    SELECT s.id AS wallet, s.key AS exchange, t.country, round(t.trend, 6) AS trend, round(s.score, 6) AS similarity
    FROM wallet_exchange s JOIN trend_part t ON t.exchange = s.key WHERE t.trend IS NOT NULL""")
def _(t):
    from ..operators.traffic import join_trend_similarity

    scored = vectors.emb_cos_sim(wallets_of(t), exchange_axis(t))
    similarity = scored.select(F.col("id").alias("wallet"), F.col("key").alias("exchange"), F.col("score").alias("similarity"))
    return join_trend_similarity(trend_of(t), similarity).select(
        "wallet", "exchange", "country", F.round("trend", 6).alias("trend"), F.round("similarity", 6).alias("similarity")
    )


@query("a18_country_score", f"""SELECT wallet, country, round(score, 6) AS score FROM ({_trend_sql('cosine', 'mean')}) r""")
def _(t):
    from ..operators.traffic import country_score, join_trend_similarity

    scored = vectors.emb_cos_sim(wallets_of(t), exchange_axis(t))
    similarity = scored.select(F.col("id").alias("wallet"), F.col("key").alias("exchange"), F.col("score").alias("similarity"))
    return country_score(join_trend_similarity(trend_of(t), similarity)).withColumn("score", F.round("score", 6))
