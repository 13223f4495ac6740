"""Vectors, urls and conversations on hand-made rows, against plain Python."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

ann = pytest.importorskip("chainlens.llm.ann")
from chainlens.llm import chat, exact_topk, url_filter  # noqa: E402

VECTORS = "vec_id bigint, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=24).astype(np.float32).tolist(), 1) for i in range(600)]
    rows += [(i, rows[7][1], 1) for i in range(600, 900)]  # a third of the rows are one vector
    rows += [(900, None, 1), (901, [], 1), (950, [0.0] * 24, None), (951, [float("nan")] + [1.0] * 23, 1),
             (1000, [float("inf")] + [1.0] * 23, 1), (1001, [None] + [1.0] * 23, 1), (None, [1.0] * 24, 1), (1050, [0.5] * 3, 1)]
    return rows


def usable(rows, zero):
    return {i: np.array(v, np.float64) for i, v, _ in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))}


@pytest.mark.parametrize("shard,block", [(8192, 2048), (100, 7)])
def test_exact_top_k(spark, vectors, shard, block):
    table = spark.createDataFrame(vectors, VECTORS).withColumn("id", F.lit("clash")).withColumn("v", F.lit(1))
    found = {}
    for r in exact_topk.exact_top_k(table, shard=shard, block=block).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    whole = {i: np.floor(256 * v).astype(np.int64) for i, v in usable(vectors, True).items()}
    for q in whole:
        if q % 50 == 0:
            scored = sorted((-int(v @ whole[q]), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:5]
            assert [found.get(q, {})[n] for n in sorted(found.get(q, {}))] == [(i, -s) for s, i in scored]
    assert set(found) <= {q for q in whole if q % 50 == 0}


def test_exact_top_k_of_huge_numbers_and_few_rows(spark):
    rows = [(0, [1e15, -3e15], 1), (1, [2e15, 1e15], 1), (2, [2e15, 1e15 + 1], 1)]
    found = exact_topk.exact_top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), scale=1)
    whole = {i: [int(x) for x in v] for i, v, _ in rows}
    assert [r["vec_id"] for r in found.orderBy("rank").collect()] == sorted(
        (1, 2), key=lambda i: (-np.int64(0) - np.array(whole[i]) @ np.array(whole[0]), i))
    assert exact_topk.exact_top_k(spark.createDataFrame([], VECTORS)).count() == 0
    assert exact_topk.exact_top_k(spark.createDataFrame([(50, [1.0], 1)], VECTORS)).count() == 0


def by_cosine(rows):
    good = usable(rows, False)
    for q in good:
        if q % 50 == 0:
            near = [(-(v @ good[q]) / (np.linalg.norm(v) * np.linalg.norm(good[q])), i) for i, v in good.items()
                    if i != q and len(v) == len(good[q])]
            yield q, sorted((round(s, 12), i) for s, i in near)[:5]


def test_nearest_neighbours(spark, vectors):
    table = spark.createDataFrame(vectors, VECTORS).withColumn("list", F.lit("clash"))
    found = {}
    for r in ann.nearest_neighbours(table).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    expect = dict(by_cosine(vectors))
    assert set(found) <= set(expect)
    hits = sum(len({i for _, i in expect[q]} & {i for _, i, _ in found.get(q, [])}) for q in expect)
    assert hits >= 0.9 * sum(len(e) for e in expect.values())
    for own in found.values():
        own.sort()
        assert [n for n, _, _ in own] == list(range(1, len(own) + 1))
        assert own == sorted(own, key=lambda x: (-x[2], x[1]))
    assert [i for _, i, _ in found[600]] == [7, 601, 602, 603, 604]


def test_nearest_of_few_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (50, [1.0, 0.1], 1), (3, [0.0, 2.0], 1)]
    found = ann.nearest_neighbours(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found) == [(0, 1, 50), (0, 2, 3), (50, 1, 0), (50, 2, 3)]
    assert ann.nearest_neighbours(spark.createDataFrame([], VECTORS)).count() == 0


def test_scan_without_abandoning_is_exact(monkeypatch):
    monkeypatch.setattr(ann, "EPSILON", 1e6)
    rng = np.random.default_rng(0)
    q, c = rng.normal(size=(9, 40)), rng.normal(size=(300, 40))
    owner, place, score = ann.scan_list(np.arange(9), q, np.arange(100, 400), c, ann.rotation(40), 5)
    every = (q @ c.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(c, axis=1)
    for i in range(9):
        assert place[owner == i].tolist() == np.argsort(-every[i])[:5].tolist()
        assert np.allclose(score[owner == i], np.sort(every[i])[::-1][:5])


URLS = [
    (1, "http://a.org/x"), (2, "https://m.Example.ORG/es/5?x#y"), (3, "http://example.org/en/17"), (4, "http://x.com/fr/1"),
    (5, "http://x.com/de/1"), (6, None), (7, "no scheme"), (8, "ftp://org"), (9, "http://notexample.org/es/1"), (10, "http://x.com"),
    (11, "http://x.net/a?b://c"), (12, "://"), (13, "http://x.com?/fr/"), (13, "http://x.com?/fr/"), (None, "http://x.com/fr/" + "é9" * 5000),
]


def test_url_rules_and_odd_rows(spark):
    table = spark.createDataFrame(URLS, "page_id bigint, url string").withColumn("w", F.lit(1)).withColumn("score", F.lit("clash"))
    found = url_filter.judge_urls(table).collect()
    assert len(found) == len(URLS)
    by_id = {r["page_id"]: r for r in found}
    rules = {1: "org/", 2: "example.org/es/", 3: "example.org/en/1", 4: "com/fr/", 5: "com/de/", 9: "org/", None: "com/fr/"}
    for page, r in by_id.items():
        assert r["rule"] == rules.get(page)
        assert r["verdict"] in ("allow", "block")
    assert (by_id[2]["host"], by_id[2]["path"]) == ("m.example.org", "/es/5")
    assert (by_id[11]["host"], by_id[11]["path"]) == ("x.net", "/a")
    assert [(by_id[i]["host"], by_id[i]["path"], by_id[i]["rule"]) for i in (6, 7, 12)] == [("", "", None)] * 3
    for i in (6, 7, 12):  # the model scores the empty string, too
        assert by_id[i]["verdict"] == ("allow" if by_id[i]["score"] >= by_id[i]["threshold"] else "block")
    assert (by_id[8]["host"], by_id[8]["path"]) == ("org", "")
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id bigint, url string")).count() == 0
    only = url_filter.judge_urls(spark.createDataFrame([(1, "http://q.net/a")], "page_id bigint, url string")).collect()
    assert only[0]["verdict"] == "allow" and only[0]["threshold"] is None


def test_url_model_tells_held_out_urls_apart(spark):
    rng = random.Random(1)
    name = lambda letters: "".join(rng.choice(letters) for _ in range(8))
    rows = [(i, f"http://{name('abcde')}.org/{name('abcde')}") for i in range(300)]
    rows += [(300 + i, f"http://{name('uvwxy')}.com/de/{name('uvwxy')}") for i in range(300)]
    rows += [(1000 + i, f"http://{name('abcde' if i % 2 else 'uvwxy')}.net/{name('abcde' if i % 2 else 'uvwxy')}") for i in range(200)]
    found = url_filter.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string")).where("page_id >= 1000").collect()
    assert sum((r["verdict"] == "allow") == (r["page_id"] % 2 == 1) for r in found) >= 190


def cheapest_by_hand(roles):
    """The least cost of any legal sequence, by trying all choices of role and merge."""
    best = 10**9
    for given in itertools.product(chat.ROLES, repeat=len(roles)):
        for merged in itertools.product((False, True), repeat=len(roles)):
            cost, last = 0, None
            for role, g, m in zip(roles, given, merged, strict=True):
                cost += 0 if role == g else chat.RELABEL if role in chat.ROLES else chat.NAME
                if m:
                    if last != g:
                        cost = None
                        break
                    cost += chat.MERGE
                    continue
                if g == "system" and last is not None:
                    cost = None
                    break
                if (g == "user" and last == "user") or (g == "assistant" and last != "user"):
                    cost += chat.INSERT
                last = g
            if cost is not None:
                best = min(best, cost + (chat.INSERT if last == "user" else 2 * chat.INSERT if last == "system" else 0))
    return best


def cost_of(roles, made):
    cost, last = 0, None
    for role, (given, merged, inserted) in zip(roles, made, strict=True):
        cost += (0 if role == given else chat.RELABEL if role in chat.ROLES else chat.NAME) + chat.MERGE * merged
        for r in (*inserted, *([] if merged else [given])):
            assert r == "system" and last is None or r == "user" and last != "user" or r == "assistant" and last == "user"
            last = r
        cost += chat.INSERT * len(inserted)
        assert last == given
    return cost + (chat.INSERT if last == "user" else 2 * chat.INSERT if last == "system" else 0)


def test_repairs_are_cheapest():
    rng = random.Random(6)
    for _ in range(150):
        roles = [rng.choice([*chat.ROLES, None, "tool"]) for _ in range(rng.randrange(1, 5))]
        assert cost_of(roles, chat.repair(roles)) == cheapest_by_hand(roles), roles


def test_a_conversation_over_many_partitions(spark):
    rng = random.Random(9)
    rows = [(1, i, rng.choice([*chat.ROLES, None]), f"t{i}") for i in range(400)]
    rows += [(2, 0, "user", None), (2, 0, "user", None), (3, 0, "assistant", "only"), (None, None, None, None), (None, 4, "system", "s")]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("part", F.lit("x"))
        found = chat.repair_conversations(table.repartition(13)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    by_conv = {}
    for r in sorted(found, key=lambda r: (r["place"], r["piece"])):
        by_conv.setdefault(r["conv_id"], []).append(r)
    roles = [r[2] for r in rows[:400]]
    first, sequence = True, []
    made = [(r["given"], r["action"].startswith("merge")) for r in by_conv[1] if r["action"] != "insert"]
    assert len(made) == 400 and [r["role"] for r in by_conv[1] if r["action"] != "insert"] == roles
    plain = chat.repair(roles)
    assert cost_of(roles, plain) == sum(
        chat.INSERT if r["action"] == "insert" else chat.MERGE * r["action"].startswith("merge")
        + (0 if r["given"] == r["role"] else chat.RELABEL if r["role"] in chat.ROLES else chat.NAME) for r in by_conv[1])
    for r in by_conv[1]:
        if not r["action"].startswith("merge"):
            assert r["rendered"].startswith(("" if first else "\n") + f"<|{r['given']}|>\n")
            sequence.append(r["given"])
            first = False
    sequence = sequence[1:] if sequence[0] == "system" else sequence
    assert sequence == ["user", "assistant"] * (len(sequence) // 2)
    assert "".join(r["rendered"] for r in by_conv[2]) == "<|user|>\n\n<|assistant|>\n"
    assert "".join(r["rendered"] for r in by_conv[3]) == "<|user|>\n\n<|assistant|>\nonly"
    assert None in by_conv
    assert chat.repair_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_equal_turns_are_spread_over_partitions(spark, monkeypatch):
    """Half of all rows are one turn: its copies fill as many partitions as they need, and each is a turn of its own."""
    rows = [(1, 5, "user", "the same")] * 3000 + [(c, k, "user", f"t{k}") for c in range(2, 602) for k in range(5)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(8)
    sizes = []
    real = chat.materialize
    monkeypatch.setattr(chat, "materialize", lambda df: sizes.append(real(df)) or sizes[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = chat.repair_conversations(table)
        assert max(r["count"] for r in sizes[0].groupBy("part").count().collect()) < 1600
        assert made.where("conv_id = 1 AND action <> 'insert'").count() == 3000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
