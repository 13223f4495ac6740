"""The ways taken for hubs, long axes and large groups give the same answer as the short ones."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from chainlens.functions import text
from chainlens.operators import graph, ranking, skipgram, vectors, walks


@pytest.fixture(scope="module")
def hub_edges(spark):
    """Node 0 owns a third of all edges and is everyone's neighbour."""
    hub = [(0, i, float(i % 7 + 1)) for i in range(1, 61)]
    spokes = [(i, 0, 2.0) for i in range(1, 61)] + [(i, (i * 7) % 60 + 1, 1.0 + i % 3) for i in range(1, 61)]
    return spark.createDataFrame(hub + spokes, "src bigint, dst bigint, weight double").dropDuplicates(["src", "dst"])


def test_blocked_cdf_equals_plain_cdf(hub_edges):
    plain = graph.build_cdf(hub_edges, max_fanout=1000)
    blocked = graph.build_cdf(hub_edges, max_fanout=8)
    assert blocked.filter("src = 0").select("block").distinct().count() > 4
    assert blocked.groupBy("src", "block").count().agg(F.max("count")).first()[0] <= 8

    def rounded(df):
        return rows(df.select("src", "dst", *[F.round(c, 9) for c in ("weight", "wsum", "cume")]))

    assert rounded(plain) == rounded(blocked)


def test_far_neighbours_share_blocks(spark):
    """Ids a million apart still fill blocks: their number follows the edges."""
    edges = spark.createDataFrame([(0, i * 1_000_003, 1.0 + i % 3) for i in range(1, 65)], "src bigint, dst bigint, weight double")
    blocked = graph.build_cdf(edges, max_fanout=8)
    sizes = blocked.groupBy("block").count()
    assert sizes.count() <= 16 and sizes.agg(F.max("count")).first()[0] <= 8
    same = lambda df: rows(df.select("dst", *[F.round(c, 9) for c in ("wsum", "cume")]))
    assert same(blocked) == same(graph.build_cdf(edges))


def test_only_nodes_that_walks_reach_are_copied(spark):
    """Node 0 has a list of many blocks and one in-edge; 1 is everyone's target and passes its walks on to 2, then 3."""
    edges = [(0, i, 1.0) for i in range(1, 61)] + [(i, 1, 1.0) for i in range(4, 61)] + [(1, 2, 1.0), (2, 3, 1.0), (3, 0, 0.1), (3, 9, 9.0)]
    edges = spark.createDataFrame(edges, "src bigint, dst bigint, weight double")
    cdf = graph.build_cdf(edges, log=False, max_fanout=8)
    adjacency = walks.build_adjacency(cdf, hot_degree=40, salts=64)
    assert {r[0] for r in rows(adjacency.hot)} == {1, 2, 3, 9}
    assert adjacency.wide is not None and adjacency.wide.count() == 1
    assert adjacency.lists.filter("node = 0").agg(F.sum(F.size("dsts"))).first()[0] == 60
    assert adjacency.lists.agg(F.sum(F.size("dsts"))).first()[0] == edges.count() + 63 * 5
    cold = walks.build_adjacency(cdf)
    assert cold.hot.isEmpty() and cold.lists.agg(F.sum(F.size("dsts"))).first()[0] == edges.count()
    seeds = edges.select(F.col("src").alias("node_id")).distinct()
    expected = rows(walks.random_walks(seeds, walks.build_adjacency(graph.build_cdf(edges, log=False)), 9))
    assert expected == rows(walks.random_walks(seeds, adjacency, 9)) == rows(walks.random_walks(seeds, cold, 9))


@pytest.mark.parametrize("policy", walks.POLICIES)
def test_hub_walks_equal_plain_walks(spark, hub_edges, policy):
    seeds = hub_edges.select(F.col("src").alias("node_id")).distinct()
    open_end = hub_edges.filter("src <> 5 AND src <> 17")
    plain = walks.build_adjacency(graph.build_cdf(open_end))
    split = walks.build_adjacency(graph.build_cdf(open_end, max_fanout=8), hot_degree=1, salts=3)
    assert plain.wide is None and not plain.split
    assert split.wide is not None and split.split and split.hot.count() > 1
    walk = lambda adjacency: rows(walks.random_walks(seeds, adjacency, 9, 2, policy, checkpoint_every=4))
    assert walk(plain) == walk(split)


def test_hops_are_edges_or_dead_end_jumps(spark, hub_edges):
    edges = hub_edges.filter("src <> 5")
    seeds = edges.select(F.col("src").alias("node_id")).distinct()
    walked = walks.random_walks(seeds, walks.build_adjacency(graph.build_cdf(edges)), 12, policy="restart", uniform="hashed")
    known = {(r.src, r.dst) for r in edges.collect()}
    sources = {s for s, _ in known}
    for row in walked.collect():
        assert len(row.path) == 13
        for a, b in zip(row.path, row.path[1:]):
            assert (a, b) in known or (a not in sources and b == row.path[0])


def test_adjacency_is_read_without_a_shuffle(spark, hub_edges):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        adjacency = walks.build_adjacency(graph.build_cdf(hub_edges))
        frontier = spark.range(20).select(F.col("id").alias("node"), F.lit(False).alias("hot"), F.lit(0.5).alias("u"), F.col("id").alias("k"))
        plan = walks.next_hop(frontier, adjacency, "u", "k")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("partitions", [1, 8])
def test_partition_count_does_not_change_ids_or_walks(spark, hub_edges, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        ids = rows(graph.assign_ids(hub_edges.select(F.concat(F.lit("w"), "dst").alias("address"))))
        names = [r[0] for r in sorted(ids, key=lambda r: r[1])]
        assert names == sorted(names) and sorted(r[1] for r in ids) == list(range(1, len(ids) + 1))
        seeds = hub_edges.select(F.col("src").alias("node_id")).distinct()
        walked = rows(walks.random_walks(seeds, walks.build_adjacency(graph.build_cdf(hub_edges)), 5))
        assert len(walked) == seeds.count()
        assert [r[1] for r in walked if r[0] == 3][0][0] == 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_running_sum_over_one_group(spark):
    data = spark.range(1000).select(F.col("id"), F.lit(1.0).alias("v"), F.floor(F.col("id") / 37).alias("b"))
    summed = ranking.running_sum(data, [], "b", ["id"], "v", "run", "all")
    assert summed.filter((F.col("run") != F.col("id") + 1) | (F.col("all") != 1000)).isEmpty()


@pytest.fixture(scope="module")
def points(spark):
    data = [(f"k{i:02d}", f"g{i % 4}", [float(i % 5 - 2), float(i % 3), float(i % 7 - 3)]) for i in range(23)]
    return spark.createDataFrame(data, "key string, group string, vector array<double>")


@pytest.mark.parametrize("kind", ["dot", "unit_dot", "cosine", "inverse_euclidean", "inverse_quadratic"])
def test_long_axis_scores_equal_short_axis_scores(points, kind):
    wallets = points.withColumnRenamed("key", "id").select("id", "vector")
    short = vectors.pair_scores(wallets, points, kind)
    long = vectors.pair_scores(wallets, points, kind, limit=4)
    rounded = lambda df: rows(df.select("id", "key", F.round("score", 9)))
    assert rounded(short) == rounded(long) and short.count() == 23 * 23


@pytest.mark.parametrize("kind", ["cosine", "inverse_euclidean"])
def test_grouped_scores_equal_averaged_pairs(points, kind):
    wallets = points.withColumnRenamed("key", "id").select("id", "vector")
    pairs = vectors.pair_scores(wallets, points, kind).filter("id <> key").join(points.select("key", "group"), "key")
    expected = rows(pairs.groupBy("id", "group").agg(F.round(F.avg("score"), 9).alias("score")))
    for limit in (1000, 4):
        scored = vectors.mean_scores_by_group(wallets, points, kind, limit=limit)
        assert rows(scored.select("id", "group", F.round("score", 9).alias("score"))) == expected


def test_wallet_country_with_a_long_axis(points, monkeypatch):
    wallets = points.withColumnRenamed("key", "id").select("id", "vector")
    anchors = points.select("key", "vector")
    values = points.select("key", F.explode(F.array(*[F.lit(c) for c in "ABCDE"])).alias("country")).withColumn(
        "value", (F.pmod(F.xxhash64("key", "country"), F.lit(10)) + 1).cast("double")
    )
    rounded = lambda df: rows(df.select(df.columns[0], df.columns[1], F.round(df.columns[2], 9)))
    short = rounded(vectors.wallet_country(wallets, anchors, values, 3))
    share = rounded(vectors.weighted_country(wallets, anchors, values, 3))
    monkeypatch.setattr(vectors, "score_rows", lambda *a, **k: None)
    monkeypatch.setattr(vectors.pair_scores, "__defaults__", ("dot", 2, 4))
    assert rounded(vectors.wallet_country(wallets, anchors, values, 3)) == short
    assert rounded(vectors.weighted_country(wallets, anchors, values, 3)) == share


@pytest.mark.parametrize("method", text.METHODS)
def test_many_candidates_match_like_few(spark, method):
    names = spark.createDataFrame([(n,) for n in ("binance", "kraken", "bitfinex", "okx", "")], "n string")
    pool = spark.createDataFrame([(c,) for c in ("binance us", "kracken", "bitfinx", "okex", "kraken", "gate", "ok", "huobi")], "c string")
    few = text.match_top(names, pool, 2, method)
    many = text.match_top(names, pool, 2, method, limit=3)
    rounded = lambda df: rows(df.select("name", F.round("score", 9), "match"))
    assert rounded(few) == rounded(many) and few.count() == 10


def test_noise_draws_follow_the_distribution(spark):
    vocab = spark.createDataFrame([(10, 1000, 0), (11, 100, 1), (12, 1, 2)], "id bigint, count bigint, index bigint")
    noise = skipgram.noise_distribution(vocab)
    assert round(noise.agg(F.sum("p")).first()[0], 9) == 1.0
    pairs = spark.range(20000).select(F.col("id").alias("walk_id"), F.lit(0).alias("pos"), F.lit(1).alias("ctx_pos"))
    drawn = skipgram.sample_negatives(pairs, noise, 3, uniform="hashed")
    assert drawn.count() == 60000 and drawn.filter("negative IS NULL").isEmpty()
    share = drawn.filter("negative = 10").count() / 60000
    expected = noise.filter("id = 10").first()["p"]
    assert abs(share - expected) < 0.01


def test_contract_filter_commutes_with_the_edge_sum(spark):
    from chainlens.operators import transfers

    data = spark.createDataFrame([("a", "b", 1.0), ("a", "x", 2.0), ("x", "b", 3.0), ("a", "b", 4.0)],
                                 "from_address string, to_address string, amount_usd double")
    contracts = spark.createDataFrame([("x",)], "address string")
    first = transfers.edge_weights(transfers.drop_contract_transfers(data, contracts))
    last = transfers.drop_contract_transfers(transfers.edge_weights(data), contracts)
    assert rows(first, "from_address", "to_address", "amount_usd") == rows(last, "from_address", "to_address", "amount_usd")


@pytest.mark.parametrize("part_nodes", [100_000, 20])
def test_default_training_finds_planted_communities(spark, part_nodes):
    """Walks on a graph of four communities, one step in ten across: near in a community, far between, at default settings."""
    rng = random.Random(7)
    paths = []
    for w in range(120):
        path = [w % 60]
        while len(path) < 20:
            home = path[-1] // 15 if rng.random() < 0.9 else rng.randrange(4)
            path.append(home * 15 + rng.randrange(15))
        paths.append((w, path))
    walked = spark.createDataFrame(paths, "walk_id bigint, path array<bigint>")
    trained = skipgram.train_vectors(walked, part_nodes=part_nodes)
    points = trained.select(F.col("id").alias("key"), F.col("embedding").alias("vector"))
    scored = vectors.similarity_matrix(points).filter("id <> key")
    near = scored.groupBy((F.floor(F.col("id") / 15) == F.floor(F.col("key") / 15)).alias("same")).agg(F.avg("score").alias("s"))
    mean = {r.same: r.s for r in near.collect()}
    assert trained.count() == 60 and mean[True] > mean[False] + 0.3, mean


def test_nearest_is_the_same_for_a_long_axis(points):
    wallets = points.withColumnRenamed("key", "id").select("id", "vector")
    rounded = lambda df: rows(df.select("id", "key", F.round("score", 9)))
    pairs = vectors.pair_scores(wallets, points, "cosine").filter("id <> key")
    expected = pairs.withColumn("r", F.expr("row_number() OVER (PARTITION BY key ORDER BY score DESC, id)")).filter("r <= 3")
    assert {r[1] for r in rounded(expected)} == {r[1] for r in rounded(vectors.nearest(wallets, points, 3))}
    scores = lambda df: rows(df.select("key", F.round("score", 9)))
    assert scores(expected) == scores(vectors.nearest(wallets, points, 3)) == scores(vectors.nearest(wallets, points, 3, limit=4))


@pytest.mark.parametrize("width", [1, 64, 50_000, 10_000_000])
def test_products_stay_within_the_cells(width):
    parts = list(vectors.row_chunks(10_000, width))
    assert all((p.stop - p.start) * width <= max(vectors.CELLS, width) for p in parts)
    assert parts[0].start == 0 and parts[-1].stop == 10_000
    assert all(a.stop == b.start for a, b in zip(parts, parts[1:], strict=False))


def test_small_products_give_the_same_scores(points):
    wallets = points.withColumnRenamed("key", "id").select("id", "vector")
    rounded = lambda df: rows(df.select("id", "key", F.round("score", 9)))
    whole = rounded(vectors.pair_scores(wallets, points, "cosine"))
    assert whole == rounded(vectors.pair_scores(wallets, points, "cosine", cells=7))
    assert whole == rounded(vectors.pair_scores(wallets, points, "cosine", limit=4, cells=9))
    assert rounded(vectors.nearest(wallets, points, 3)) == rounded(vectors.nearest(wallets, points, 3, cells=5))


def test_cumulative_share_spreads_equal_values(spark, monkeypatch):
    """All values are of one magnitude, two thirds are ties."""
    from chainlens.operators import metrics

    given = [(i, 1.0 if i % 3 else 1.0 + i / 4000) for i in range(3000)]
    seen = []
    inner = metrics.running_sum
    monkeypatch.setattr(metrics, "running_sum", lambda df, keys, block, *rest: seen.append((df, block)) or inner(df, keys, block, *rest))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = metrics.cumulative_share(spark.createDataFrame(given, "feature int, importance double")).collect()
        df, block = seen[0]
        assert df.groupBy(block).count().agg(F.max("count")).first()[0] < 1500
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    total, run, expect = sum(v for _, v in given), 0.0, {}
    for feature, value in sorted(given, key=lambda r: (-r[1], r[0])):
        run += value
        expect[feature] = run / total
    assert len(made) == 3000 and all(abs(r["cumulative_share"] - expect[r["feature"]]) < 1e-9 for r in made)


def test_training_groups_stay_bounded_around_a_hub(spark, monkeypatch):
    """Node 0 follows itself on most places: nearly all pairs are of one group."""
    given = [(w, [0, 0, 0, 0, 0, w % 40]) for w in range(400)]
    largest = []

    def step(vectors, pairs, dim, parts, turn, *rest):
        largest.append(pairs.groupBy("center_part").count().agg(F.max("count")).first()[0] or 0)
        return vectors

    monkeypatch.setattr(skipgram, "block_step", step)
    walked = spark.createDataFrame(given, "walk_id bigint, path array<bigint>")
    skipgram.train_vectors(walked, dim=2, window=2, negatives=1, epochs=1, part_nodes=10, group_pairs=2000)
    assert max(largest) <= 2000 * 1.25


def test_a_turn_reads_its_own_pairs(spark):
    walked = spark.createDataFrame([(w, [(w * k) % 90 for k in range(1, 9)]) for w in range(200)], "walk_id bigint, path array<bigint>")
    pairs = skipgram.skipgram_pairs(walked, 3)
    store = skipgram.PairStore(pairs, 6)
    turns = [store.of_turn(t) for t in range(6)]
    assert sum(t.count() for t in turns) == pairs.count()
    for n, turn in enumerate(turns):
        plan = turn._jdf.queryExecution().executedPlan().toString()
        assert f"(turn#" in plan and "PartitionFilters: [isnotnull(turn" in plan
        files = turn.select(F.input_file_name().alias("f")).distinct().collect()
        assert files and all(f"/turn={n}/" in r["f"] for r in files)
        apart = F.pmod(F.xxhash64("other"), F.lit(6)) - F.pmod(F.xxhash64("center"), F.lit(6))
        assert not turn.where(F.pmod(apart, F.lit(6)) != n).count()
    store.remove()


def test_training_is_repeatable(spark):
    walked = spark.createDataFrame([(w, [(w * k) % 50 for k in range(1, 9)]) for w in range(100)], "walk_id bigint, path array<bigint>")
    runs = [rows(skipgram.train_vectors(w, dim=4, epochs=2, part_nodes=20)) for w in (walked, walked.repartition(5))]
    assert runs[0] == runs[1] and len(runs[0]) == 50


def test_sparse_groups_stay_within_the_cells(monkeypatch):
    """20,000 members in 20,000 groups: every array of a batch of 500 rows is bounded, and the own member is left out."""
    import numpy as np

    rng = np.random.default_rng(1)
    matrix = rng.normal(size=(20_000, 3))
    axis = vectors.GroupedAxis([f"k{i}" for i in range(20_000)], [f"g{i:05d}" for i in range(20_000)], matrix)
    seen = []
    inner = vectors._score_block
    monkeypatch.setattr(vectors, "_score_block", lambda *a: seen.append(inner(*a)) or seen[-1])
    ids = [f"k{i}" for i in range(250)] + ["none"] * 250
    left = rng.normal(size=(500, 3))
    cells, done = 400_000, 0
    for part, total, number in axis.sums("dot", ids, left, True, cells):
        assert total.size <= cells and number.size <= cells and seen[-1].size <= cells
        for at in range(part.start, part.stop):
            own = number[at - part.start] == 0
            assert own.sum() == (at < 250) and (at >= 250 or axis.groups[own][0] == f"g{at:05d}")
        assert np.allclose(total[number > 0], (left[part] @ matrix.T)[number > 0])
        done += len(total)
    assert done == 500


def test_groups_of_repeated_keys(spark):
    """A key in two groups is left out of both; a group of the own key alone has no mean."""
    members = spark.createDataFrame([("a", "x", [1.0, 0.0]), ("a", "y", [1.0, 0.0]), ("b", "y", [0.0, 1.0])], "key string, group string, vector array<double>")
    wallets = spark.createDataFrame([("a", [1.0, 1.0]), ("c", [2.0, 0.0])], "id string, vector array<double>")
    expect = [("a", "x", None), ("a", "y", 1.0), ("c", "x", 2.0), ("c", "y", 1.0)]
    for limit in (100, 1):
        assert rows(vectors.mean_scores_by_group(wallets, members, "dot", limit=limit)) == rows(spark.createDataFrame(expect, "id string, group string, score double"))


def test_cosine_means_never_pair_wallets_with_members(points, monkeypatch):
    """23 members in 4 groups: the products are as wide as the groups, on a short axis and on a long one."""
    wallets = points.withColumnRenamed("key", "id").select("id", "vector")
    rounded = lambda df: rows(df.select("id", "group", F.round("score", 9)))
    short = rounded(vectors.mean_scores_by_group(wallets, points))
    assert len(short) == 23 * 4
    monkeypatch.setattr(vectors, "_sharded_by_group", lambda *a: pytest.fail("pairs were made"), raising=False)
    assert rounded(vectors.mean_scores_by_group(wallets, points, limit=10)) == short
    held = points.collect()
    axis = vectors.GroupedAxis([r.key for r in held], [r.group for r in held], vectors.np.array([r.vector for r in held]))
    inner, seen = vectors._score_block, []
    monkeypatch.setattr(vectors, "_score_block", lambda *a: seen.append(inner(*a)) or seen[-1])
    list(axis.sums("cosine", [r.key for r in held], axis.matrix, True, 1000))
    assert all(block.shape[1] == 4 for block in seen)


def test_long_blocks_hold_whole_groups(spark):
    """400 members in 4 groups and sides of 100: a group meets a vector in one or two blocks, not in all."""
    given = [(f"k{i:03d}", f"g{i % 4}", [float(i), 1.0]) for i in range(400)]
    axis = spark.createDataFrame(given, "key string, group string, vector array<double>")
    _, right = vectors._sharded_by_group(axis.select(F.col("key").alias("id"), "vector"), axis, 100)
    assert right.groupBy("axis_group").agg(F.count_distinct("block").alias("n")).agg(F.max("n")).first()[0] <= 2


def test_distances_of_close_vectors_are_exact():
    import numpy as np

    left = np.array([[1e6, 1.0], [1e6, 1.0 + 1e-9], [0.0, 2.0]])
    right = np.array([[1e6, 1.0], [1e6 + 1e-3, 1.0], [3.0, 2.0]])
    squares = ((left[:, None, :] - right[None, :, :]) ** 2).sum(axis=2)
    expected = np.where(squares > 0, 1.0 / np.where(squares > 0, squares, 1.0), np.nan)
    assert np.allclose(vectors._score_block("inverse_quadratic", left, right), expected, rtol=1e-9, equal_nan=True)
    assert np.allclose(vectors._score_block("inverse_euclidean", left, right), np.sqrt(expected), rtol=1e-9, equal_nan=True)


def test_negatives_are_the_same_joined_and_in_place(spark):
    """Ranks of 300 tokens: workers that hold the distribution draw what the join by cells draws."""
    vocab = spark.createDataFrame([(1000 + i, 300 // (i + 1) + 1, i) for i in range(300)], "id bigint, count bigint, index bigint")
    noise = skipgram.noise_distribution(vocab)
    pairs = spark.range(500).select(F.col("id").alias("walk_id"), F.lit(0).alias("pos"), F.lit(1).alias("ctx_pos"))
    for uniform in ("hashed", "portable"):
        place = skipgram.sample_negatives(pairs, noise, 4, uniform=uniform)
        joined = skipgram.sample_negatives(pairs, noise, 4, uniform=uniform, limit=10)
        names = ("walk_id", "draw", "negative")
        assert rows(place, *names) == rows(joined, *names) and place.count() == 2000
        assert "Join" not in place._jdf.queryExecution().optimizedPlan().toString()


def test_turns_follow_the_work():
    """Small parts on request do not make a job for each; many pairs make tasks where one part would be one task."""
    assert skipgram.part_count(216_000, 8_000_000, 200) == 16
    assert skipgram.part_count(216_000, 8_000_000, 500_000) == 5
    assert skipgram.part_count(60, 30_000, 20) == 3 and skipgram.part_count(60, 30_000, 100_000) == 1
    assert skipgram.part_count(50_000_000, 1, 200) == 100 and skipgram.part_count(0, 0, 10) == 1


def test_hops_sort_no_lists(spark, hub_edges):
    adjacency = walks.build_adjacency(graph.build_cdf(hub_edges))
    frontier = spark.range(20).select(F.col("id").alias("node"), F.lit(False).alias("hot"), F.lit(0.5).alias("u"), F.col("id").alias("k"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = walks.next_hop(frontier, adjacency, "u", "k")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ShuffledHashJoin" in plan and "BuildLeft" in plan and "Sort [" not in plan


def test_flows_need_no_sums_per_pair(spark):
    """Unknown, null and repeated addresses count as in the sums per pair; the only sum is that of the countries."""
    from chainlens.operators import flows

    given = [(f"a{i % 7}" if i % 11 else None, f"a{i % 5}", float(i), float(i) if i % 3 else None) for i in range(200)]
    sent = spark.createDataFrame(given, "from_address string, to_address string, amount double, amount_usd double")
    known = spark.createDataFrame([("a0", "X"), ("a1", "Y"), ("a1", "Z"), ("a2", "X"), ("a3", None), (None, "Y")], "address string, country string")
    found = flows.flow_between(sent, known)
    assert rows(found) == rows(flows.country_flows(flows.label_flow(flows.sum_pairs(sent), known))) and found.count() > 4
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1


def test_partial_sums_meet_in_bounded_partitions(spark):
    from chainlens.operators import transfers

    sums = spark.range(300).selectExpr("CAST(id AS STRING) AS from_address", "'b' AS to_address", "1.0D AS amount_usd")
    merged = transfers.merge_partial_edges(sums, sums, per_task=20)
    assert merged.count() == 300 and merged.agg(F.sum("amount_usd")).first()[0] == 600.0
    assert "hashpartitioning(from_address" in (plan := merged._jdf.queryExecution().optimizedPlan().toString()) or "30" in plan
    assert "RepartitionByExpression" in plan and ", 30" in plan
