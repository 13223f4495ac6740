"""The prefix trie on hand-made conversations, against plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

trie = pytest.importorskip("chainlens.llm.prefix_trie")

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, n int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    skipped = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100 if c >= 0 else c + -c % 100, [])[:skipped[c]] + ts[skipped[c]:] for c, ts in own.items()}


def expected(rows):
    convs = rebuilt(rows)
    members = {}
    for c, path in convs.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    saved, leaves = {}, {}
    for node, held in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] = saved.get(node[:d], 0) + ((len(held) - 1) * len(node[-1][1]) if node else 0)
            leaves[node[:d]] = leaves.get(node[:d], 0) + (node not in children)
    for node, held in members.items():
        ends = sorted(c for c in held if len(convs[c]) == len(node))
        yield (min(held), len(node), min(members[node[:-1]]) if node else None, len(held), children.get(node, 0), leaves[node],
               saved[node], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())


def run(spark, rows, most=500_000):
    table = spark.createDataFrame(rows, SCHEMA)
    found = trie.prefix_trie(trie.rebuilt_turns(trie.ordered_turns(table)), most)
    return sorted((tuple(r) for r in found.select(*COLUMNS).collect()), key=str)


def made(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(-3, 60), *range(100, 160), 230, 231]:  # 200 is absent
        for turn in range(rng.choice([1, 1, 2, 3, 5, 8, 12])):
            rows.append((conv, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]),
                         rng.choice(["a", "bb", "a", None, "é\U0001f600", "long " * 4000 if conv == 7 else "c"]), "clash", 1))
    for conv in range(1000, 1080):  # a third are copies of one conversation
        rows += [(conv, k, "user", "same", "clash", 1) for k in range(9)]
    rows += [(5000, 1, "user", "hot", "clash", 2)] * 400  # one conversation of equal turns, and a copy of it
    rows += [(5001, 1, "user", "hot", "clash", 2)] * 400
    rows += rows[:30] + [(None, 1, "user", "nobody", None, None), (300, None, None, None, None, None)]
    # different turns of one number and role go by a hash, so such rows are made equal
    settled = {}
    for r in rows:
        settled.setdefault((r[0], r[1], r[2] or ""), r)
    return [settled[r[0], r[1], r[2] or ""] for r in rows]


@pytest.mark.parametrize("seed,most", [(1, 500_000), (2, 0)])
def test_against_plain_python(spark, seed, most):
    rows = made(seed)
    assert run(spark, rows, most) == sorted(expected(rows), key=str)


def test_links_over_many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(9)
        # few different turns, so that most links are shared by partitions; conversations that end inside others
        rows = [(c, k, "user", rng.choice("ab") if k % 7 else "x", None, 1) for c in range(400) for k in range(rng.randint(1, 9))]
        skeletons = []
        real = trie._stack
        trie._stack = lambda shared, skeleton: skeletons.append((shared, skeleton)) or real(shared, skeleton)
        try:
            assert run(spark, rows) == sorted(expected(rows), key=str)
            assert run(spark, rows, 0) == sorted(expected(rows), key=str)
        finally:
            trie._stack = real
        shared, skeleton = skeletons[0]
        assert len(shared) > 8 and any(b > 1 for b, _ in shared.values()) and len(skeleton) > 10
        assert skeletons[1][1] is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_and_turnless(spark):
    assert run(spark, []) == []
    conv = next(c for c in range(201, 300) if zlib.crc32(str(c).encode()) % 6 > 1)
    found = run(spark, [(conv, 1, "user", "x", None, None)])  # its one turn is skipped, and there is no 200
    assert found == [(conv, 0, None, 1, 0, 1, 0, hashlib.sha256(str(conv).encode()).hexdigest())]


def test_a_long_conversation_is_one_link(spark):
    rows = spark.range(20000).select(F.lit(600).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"),
                                     F.col("id").cast("string").alias("text"))
    sums = []
    real = trie.link_sums
    trie.link_sums = lambda paths, most: sums.append(paths.select(F.size("path").alias("n")).collect()) or real(paths, most)
    try:
        assert trie.prefix_trie(trie.rebuilt_turns(trie.ordered_turns(rows))).count() == 20001
    finally:
        trie.link_sums = real
    assert [r["n"] for r in sums[0]] == [1]
