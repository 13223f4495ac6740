"""Draws are independent between hops, walks, seeds and pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainlens.functions.rng import UNIFORMS
from chainlens.operators import graph, skipgram, traffic, walks


def matrix(spark, uniform, rows=2000, draws=12, seed=42):
    made = spark.range(rows).select("id", *[F.expr(UNIFORMS[uniform]("id", d, seed)).alias(f"d{d}") for d in range(draws)])
    return np.array(made.orderBy("id").toPandas())[:, 1:]


@pytest.mark.parametrize("uniform", ["hashed", "portable"])
def test_draws_of_a_walk_are_uniform_and_unrelated(spark, uniform):
    u = matrix(spark, uniform)
    assert u.min() >= 0 and u.max() < 1
    counts = np.histogram(u, bins=50, range=(0, 1))[0]
    assert ((counts - u.size / 50) ** 2 / (u.size / 50)).sum() < 95  # chi-square, 49 degrees of freedom
    assert abs(np.corrcoef(u[:, :-1].ravel(), u[:, 1:].ravel())[0, 1]) < 0.03
    assert abs(np.corrcoef(u[:-1].ravel(), u[1:].ravel())[0, 1]) < 0.03
    steps = np.mod(np.diff(u, axis=1), 1.0)
    assert len(np.unique(np.round(steps, 9))) > 0.99 * steps.size
    other = matrix(spark, uniform, seed=43)
    assert abs(np.corrcoef(u.ravel(), other.ravel())[0, 1]) < 0.03
    assert len(np.unique(u.round(12), axis=0)) == len(u)


def test_negatives_of_far_walks_differ(spark):
    vocab = spark.range(200).select("id", F.lit(5).cast("bigint").alias("count"), F.col("id").alias("index"))
    noise = skipgram.noise_distribution(vocab)
    ids = spark.createDataFrame([(0,), (524_288,), (1 << 33,)], "walk_id bigint")
    pairs = ids.crossJoin(spark.range(90).select(F.col("id").alias("pos"), (F.col("id") + 1).alias("ctx_pos"))).select(
        "walk_id", "pos", "ctx_pos", F.lit(1).alias("center"), F.lit(2).alias("context"))
    drawn = skipgram.sample_negatives(pairs, noise, 3).orderBy("walk_id", "pos", "draw").toPandas()
    a, b, c = (drawn[drawn.walk_id == w].negative.to_numpy() for w in (0, 524_288, 1 << 33))
    assert len(a) == 270 and (a == b).mean() < 0.05 and (a == c).mean() < 0.05
    assert (a[:192] == np.roll(a, 192)[:192]).mean() < 0.05  # positions 64 apart


def test_hops_follow_the_weights(spark):
    edges = [(0, 1, 1.0), (0, 2, 3.0), (1, 0, 1.0), (2, 0, 1.0)]
    adjacency = walks.build_adjacency(graph.build_cdf(spark.createDataFrame(edges, "src bigint, dst bigint, weight double"), log=False))
    seeds = spark.createDataFrame([(0,)], "node_id bigint")
    paths = np.array([r["path"] for r in walks.random_walks(seeds, adjacency, 10, walks_per_seed=800).collect()])
    taken = (paths[:, 1::2] == 2)
    assert abs(taken.mean() - 0.75) < 0.03
    assert abs(np.corrcoef(taken[:, :-1].ravel(), taken[:, 1:].ravel())[0, 1]) < 0.06


def test_an_exchange_without_traffic_does_not_hide_one_with(spark):
    cex = spark.createDataFrame(
        [("a", "X", "ETH"), ("b", "x", "ETH"), ("Gate.io", "g", "ETH"), ("b", "n", "BTC")], "exchange string, address string, network string")
    shares = spark.createDataFrame([("B", "P", 0.4), ("b", "Q", 0.6), ("gate", "P", 1.0)], "cex string, country string, share double")
    found = traffic.match_exchange_traffic(cex, shares).collect()
    assert sorted(tuple(r) for r in found) == [("b", "x", "P", 0.4), ("b", "x", "Q", 0.6), ("gate", "g", "P", 1.0)]


def test_trend_names_meet_the_address_list(spark):
    trend = spark.createDataFrame([("Gate", "P", 0.5), ("Exch", "P", 0.5)], "exchange string, country string, trend double")
    similar = spark.createDataFrame([("w", "Gate.io", 0.2), ("w", "Exch", 0.1)], "wallet string, exchange string, similarity double")
    assert traffic.join_trend_similarity(trend, similar).count() == 2
