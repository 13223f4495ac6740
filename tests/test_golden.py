"""Hand-made rows for the cases where a plain rewrite would differ."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from chainlens.functions import dates, text, vector_math
from chainlens.operators import activity, dao, evidence, flows, graph, metrics, relational, sampling, traffic, transfers, vectors, walks
from chainlens.operators.ranking import dense_ids


def table(spark, data, schema):
    return spark.createDataFrame(data, schema)


def chain(spark):
    edges = table(spark, [(1, 2, 5.0), (2, 3, 5.0)], "src bigint, dst bigint, weight double")
    seeds = table(spark, [(1,)], "node_id bigint")
    return seeds, walks.build_adjacency(graph.build_cdf(edges))


@pytest.mark.parametrize("policy,path", [("restart", [1, 2, 3, 1, 2]), ("terminate", [1, 2, 3]), ("teleport", [1, 2, 3, 1, 2])])
def test_walk_policies_on_a_chain(spark, policy, path):
    seeds, adjacency = chain(spark)
    assert walks.random_walks(seeds, adjacency, 4, policy=policy).first()["path"] == path


def test_walks_reject_unknown_policy(spark):
    seeds, adjacency = chain(spark)
    with pytest.raises(ValueError):
        walks.random_walks(seeds, adjacency, 4, policy="stay")


def test_checkpoint_spacing_does_not_change_walks(spark):
    seeds, adjacency = chain(spark)
    results = [
        walks.random_walks(seeds, adjacency, 7, policy=p, checkpoint_every=k).first()["path"]
        for p in walks.POLICIES for k in (1, 3, 7)
    ]
    assert results[0:3] == [results[0]] * 3 and results[3:6] == [results[3]] * 3 and results[6:9] == [results[6]] * 3


def test_cdf_keeps_positive_weights_only(spark):
    edges = table(spark, [(1, 2, -3.0), (1, 3, 0.0), (1, 4, None), (1, 5, 1.0), (1, 6, 2.0)],
                  "src bigint, dst bigint, weight double")
    result = graph.build_cdf(edges, log=False).orderBy("dst").collect()
    assert [(r.dst, r.cume, r.wsum) for r in result] == [(5, 1.0, 3.0), (6, 3.0, 3.0)]


def test_edge_weights_drop_null_keys_and_zero_null_sums(spark):
    transfer = table(spark, [("a", "b", None), ("a", "b", None), (None, "b", 3.0), ("a", "c", float("nan")), ("a", "c", 2.0)],
                     "from_address string, to_address string, amount_usd double")
    assert rows(transfers.edge_weights(transfer)) == [("a", "b", 0.0), ("a", "c", 2.0)]


def test_null_contract_matches_nothing(spark):
    transfer = table(spark, [(None, "b"), ("a", "b"), ("a", "x")], "from_address string, to_address string")
    contracts = table(spark, [("x",), (None,)], "address string")
    assert rows(transfers.drop_contract_transfers(transfer, contracts), "from_address", "to_address") == [(None, "b"), ("a", "b")]


def flow_rows(spark):
    return table(spark, [("A", "B", 10.0), ("B", "A", 4.0), ("C", "A", 3.0)], "source string, target string, amount_usd double")


def test_bilateral_net_flow(spark):
    assert rows(flows.bilateral_net_flow(flow_rows(spark))) == [("A", "B", 6.0)]


def test_net_outflow(spark):
    assert rows(flows.net_outflow(flow_rows(spark))) == [("A", 3.0), ("B", -6.0), ("C", None)]
    assert rows(flows.net_outflow(flow_rows(spark), "zero")) == [("A", 3.0), ("B", -6.0), ("C", 3.0)]


def test_flow_matrix_and_share(spark):
    flow = table(spark, [("A", "B", 1.0, 30.0), ("B", "A", 1.0, 10.0)], "from_country string, to_country string, amount double, amount_usd double")
    shared = flows.flow_share(flow)
    assert rows(shared) == [("A", "B", 30.0, 75.0), ("B", "A", 10.0, 25.0)]
    assert rows(flows.flow_matrix(flows.bilateral_net_flow(shared), ["B", "A"])) == [("A", 0.0, 20.0)]


def test_participation(spark):
    votes = table(spark, [("s", "p", "v1", None, True), ("s", "p", "v2", "small", False), ("s", "p", "v1", None, True)],
                  "space string, id string, voter string, label string, is_user boolean")
    assert rows(dao.participation_ratio(votes)) == [("s", "p", 0.5, None, 0.5)]


def test_prior_transfer_is_point_in_time(spark):
    votes = table(spark, [("s", "p", 100, "a", "x"), ("s", "p", 100, "b", "x"), ("t", "q", 100, "a", "x")],
                  "space string, id string, created bigint, voter string, label string")
    moved = table(spark, [("s", "a", "z", 100), ("s", "z", "b", 101)],
                  "space string, from_address string, to_address string, block_timestamp bigint")
    assert rows(dao.voters_with_prior_transfer(votes, moved), "voter", "is_user") == [("a", True), ("b", False)]


def test_histogram_without_dst_transfers_is_zero(spark):
    january_noon = 1704110400
    moved = table(spark, [("a", january_noon), ("a", january_noon + 3600)], "from_address string, block_timestamp bigint")
    row = activity.normalize_histogram(activity.hour_histogram(moved)).first()
    assert [row[f"dst_{h}"] for h in range(24)] == [0.0] * 24
    assert row["all_12"] == row["non_dst_13"] == 0.5


def test_epoch_parts_ignore_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        seconds = table(spark, [(0,), (-1,)], "s bigint")
        found = seconds.select("s", dates.epoch_hour("s"), dates.epoch_month("s"), dates.epoch_year("s")).collect()
        assert sorted(tuple(r) for r in found) == [(-1, 23, 12, 1969), (0, 0, 1, 1970)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_year_range(spark):
    data = table(spark, [("a", 2015), ("b", 2017), ("c", None), ("d", 2010)], "k string, latest int")
    assert rows(dates.year_range(data, 2015, "latest")) == [("b", 2015), ("b", 2016)]


@pytest.mark.parametrize("raw,clean", [
    ("Crypto.com (Exchange)", "crypto com exchange"), ("BtcTurk | Kripto", "btcturk kripto"), ("XT.COM", "xt com"),
    ("Gate.io", "gate io"), ("a-b/c+d&e'f\"g", "a b c d e f g"), ("()", ""),
])
def test_clean_name(spark, raw, clean):
    assert table(spark, [(raw,)], "n string").select(text.clean_name("n")).first()[0] == clean


@pytest.mark.parametrize("raw,clean", [
    ("alice.eth", "alice"), ("[0123456789abcdef0123].addr.reverse", None), ("reverse", None), ("0123456789ABCDEF", None),
    ("abc123", "abc123"), ("[x]y].eth", "x]y"), ("a.eth.eth", "a.eth"),
])
def test_clean_ens(spark, raw, clean):
    assert table(spark, [(raw,)], "n string").select(text.clean_ens("n")).first()[0] == clean


def test_similarity_methods(spark):
    pair = table(spark, [("ca", "abc"), ("", ""), ("martha", "marhta")], "a string, b string")
    got = {m: [round(r[0], 4) for r in pair.select(text.name_similarity("a", "b", m)).collect()] for m in text.METHODS}
    assert got == {"lev": [0.0, 1.0, 0.6667], "dam_lev": [0.3333, 1.0, 0.8333], "jaro": [0.0, 1.0, 0.9444], "jaro_win": [0.0, 1.0, 0.9611]}


def test_split_even(spark):
    numbered = dense_ids(table(spark, [(i,) for i in range(10)], "v int"), [F.col("v")], "seed_index")
    for mode in ("contiguous", "roundrobin"):
        sizes = walks.split_even(numbered, 4, mode).groupBy("part").count().orderBy("part").collect()
        assert [r["count"] for r in sizes] == [3, 3, 2, 2]
        assert walks.split_even(numbered, 99, mode).select("part").distinct().count() == 10


def test_dedup_keeps_the_first(spark):
    data = table(spark, [("k", 2, "b"), ("k", 1, "z"), ("m", 5, None)], "k string, n int, v string")
    assert rows(relational.dedup(data, ["k"], ["n"])) == [("k", 1, "z"), ("m", 5, None)]


def test_owner_with_two_domains_stays(spark):
    data = table(spark, [("d1", "o1"), ("d2", "o1"), ("d3", "o2"), ("d3", "o2")], "ens_domain string, owner string")
    assert rows(evidence.drop_ambiguous(data, ["ens_domain", "owner"], "owner"), "ens_domain", "owner") == [("d1", "o1"), ("d2", "o1")]


def test_unique_country(spark):
    data = table(spark, [("a", "X"), ("a", "X"), ("b", "X"), ("b", "Y"), (None, "X")], "address string, country string")
    assert rows(evidence.unique_country_wallets(data)) == [("a", "X")]


def test_to_number(spark):
    data = table(spark, [("<1",), ("7",), ("x",), (None,)], "t string")
    assert [r[0] for r in data.select(relational.to_number("t")).collect()] == [0.0, 7.0, None, None]


def test_missing_flag_counts_as_flagged_by_default(spark):
    panel = table(spark, [("e", "a", "K", 1.0)], "exchange string, address string, country string, value double")
    flags = table(spark, [("other", True)], "exchange string, is_china boolean")
    assert rows(traffic.china_mix(panel, flags, 0.5)) == [("e", "a", "China", 0.5), ("e", "a", "K", 0.5)]
    assert rows(traffic.china_mix(panel, flags, 0.5, False)) == [("e", "a", "China", 0.0), ("e", "a", "K", 1.0)]


def test_argmax_first_wins_and_top_k_order(spark):
    data = table(spark, [([0.1, 0.4, 0.4, 0.1],)], "p array<double>")
    row = data.select(vector_math.argmax("p"), vector_math.top_k_positions("p", 3)).first()
    assert row[0] == 1 and row[1] == [2, 1, 3]


def test_unknown_label_is_marked(spark):
    probs = table(spark, [(1, "Z", "A", 0.6), (1, "Z", "B", 0.4)], "id int, label string, class string, p double")
    row = metrics.prediction_frame(probs).first()
    assert (row.known_label, row.correct, row.correct_confidence, row.brier) == (False, False, None, None)


def test_vector_edge_cases(spark):
    data = table(spark, [([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in data.select(vector_math.cosine_similarity("a", "b")).collect()] == [0.0, 1.0]
    assert [r[0] for r in data.select(vector_math.inverse_euclidean("a", "b")).collect()] == [1.0, None]


def test_standardize_of_equal_values_is_null(spark):
    data = table(spark, [(1, 0.1), (1, 0.1), (1, 0.1)], "g int, x double")
    assert {r.p for r in vectors.standardize(data, ["g"], "x", "p").collect()} == {None}


def test_masked_mean_of_an_all_masked_text_is_zero(spark):
    data = table(spark, [(1, 0, [1.0, 2.0]), (2, 1, [1.0, 2.0]), (2, 1, [3.0, 4.0])], "t int, m int, v array<double>")
    assert rows(vectors.masked_mean(data, "t", "m", "v", 2)) == [(1, [0.0, 0.0]), (2, [2.0, 3.0])]


def test_folds_are_even_per_class(spark):
    data = table(spark, [(i, "a" if i < 67 else "b") for i in range(100)], "id int, label string")
    counts = sampling.stratified_folds(data, "label", "id", 5).groupBy("label", "fold").count().collect()
    for label in "ab":
        sizes = [r["count"] for r in counts if r.label == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
