"""Softmax boosting against a plain-Python twin, and its sampling, penalties, search and storage."""

import math
import random

import pytest
from pyspark.sql import functions as F

from chainlens.operators import boosting, learn, sampling
from chainlens.operators.boosting import UNIT, Settings


def table(seed, n=200, classes=3):
    rng = random.Random(seed)
    return [(i, i % classes, [rng.gauss(1.5 * (i % classes == k), 1.0) for k in range(4)] + [rng.choice([0.0, 1.0, None, float("nan")])])
            for i in range(n)]


def twin(rows, codes, keys, settings, classes):
    """Trees as nested tuples (feature, bin, left, right) or a weight, and margins; loops over rows only."""
    margins = [[0.0] * classes for _ in rows]
    forest = []

    def shrink(g):
        return math.copysign(max(abs(g) - settings.alpha, 0.0), g)

    def score(g, h):
        return shrink(g) ** 2 / (h + settings.penalty)

    for number in range(settings.rounds):
        grads = []
        for m, (_, y, _) in zip(margins, rows):
            e = [math.exp(x - max(m)) for x in m]
            p = [x / sum(e) for x in e]
            grads.append([(round((q - (k == y)) * UNIT) / UNIT, max(round(2 * q * (1 - q) * UNIT), 1) / UNIT) for k, q in enumerate(p)])
        taken = [i for i in range(len(rows)) if keys[number][i]]
        trees = []
        for k in range(classes):
            allowed = boosting.chosen_features(5, settings, number, k)

            def grow(members, depth):
                g, h = sum(grads[i][k][0] for i in members), sum(grads[i][k][1] for i in members)
                leaf = -settings.step * shrink(g) / (h + settings.penalty)
                best = (1e-6, None)
                for f in allowed if depth < settings.depth else ():
                    for b in range(max(codes[i][f] for i in range(len(rows)))):
                        left = [i for i in members if codes[i][f] <= b]
                        gl, hl = sum(grads[i][k][0] for i in left), sum(grads[i][k][1] for i in left)
                        if min(hl, h - hl) >= settings.child_weight:
                            gain = score(gl, hl) + score(g - gl, h - hl) - score(g, h)
                            if gain > best[0] + 1e-12:
                                best = (gain, (f, b))
                if best[1] is None:
                    return leaf
                f, b = best[1]
                sides = [grow([i for i in members if (codes[i][f] > b) == side], depth + 1) for side in (False, True)]
                if best[0] < settings.gamma and not any(isinstance(s, tuple) for s in sides):
                    return leaf
                return (f, b, *sides)

            trees.append(grow(taken, 0) if taken else 0.0)
        for m, code in zip(margins, codes):
            for k, tree in enumerate(trees):
                while isinstance(tree, tuple):
                    tree = tree[3] if code[tree[0]] > tree[1] else tree[2]
                m[k] += tree
        forest.append(trees)
    return forest, margins


def nested(tree, node=0):
    if tree.feature[node] < 0:
        return tree.weight[node]
    left = tree.left[node]
    return (tree.feature[node], tree.bin[node], nested(tree, left), nested(tree, left + 1))


def same(a, b):
    if isinstance(a, tuple) != isinstance(b, tuple):
        return False
    return a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3]) if isinstance(a, tuple) else abs(a - b) < 1e-9


@pytest.mark.parametrize("settings", [
    Settings(rounds=4, depth=3, bins=16), Settings(rounds=12, depth=2, step=0.1, bins=8, penalty=5.0, alpha=0.1),
    Settings(rounds=3, depth=4, row_share=0.7, feature_share=0.6, child_weight=3.0, gamma=0.5, bins=8)])
def test_equal_to_plain_python(spark, settings):
    rows = table(settings.rounds)
    df = spark.createDataFrame(rows, "id bigint, label_index int, features array<double>").repartition(5)
    model = boosting.train(df, settings)
    codes = boosting.code_rows([r[2] for r in rows], model.edges)
    import numpy as np
    hashes = {r["id"]: r["k"] for r in df.select("id", F.xxhash64("id").alias("k")).collect()}
    keys = [boosting.drawn(np.array([hashes[r[0]] for r in rows]), settings, n) for n in range(settings.rounds)]
    if settings.row_share < 1:
        assert all(0.55 < k.mean() < 0.85 for k in keys) and (keys[0] != keys[1]).any()
    forest, margins = twin(rows, codes.tolist(), keys, settings, 3)
    for trees, expect in zip(model.rounds, forest, strict=True):
        assert all(same(nested(t), e) for t, e in zip(trees, expect, strict=True))
    found = {r["id"]: r for r in model.transform(df, chances="p").collect()}
    for r, m in zip(rows, margins):
        got = found[r[0]]
        assert got["prediction_index"] == m.index(max(m)) and abs(sum(got["p"]) - 1) < 1e-9
        assert max(abs(math.log(got["p"][k] / got["p"][0]) - (m[k] - m[0])) for k in range(3)) < 1e-6


def test_partitioning_does_not_change_the_trees(spark):
    df = spark.createDataFrame(table(9, 500), "id bigint, label_index int, features array<double>")
    settings = Settings(rounds=3, depth=3, row_share=0.8)
    models = [boosting.train(df.repartition(n), settings) for n in (1, 7)]
    assert [[nested(t) for t in r] for r in models[0].rounds] == [[nested(t) for t in r] for r in models[1].rounds]


def test_small_memory_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame(table(5, 300), "id bigint, label_index int, features array<double>")
    settings = Settings(rounds=2, depth=3)
    whole = boosting.train(df, settings)
    monkeypatch.setattr(boosting, "CELLS", 1000)
    slices = boosting.train(df, settings)
    assert [[nested(t) for t in r] for r in whole.rounds] == [[nested(t) for t in r] for r in slices.rounds]


def test_odd_tables(spark):
    schema = "id bigint, label_index int, features array<double>"
    empty = boosting.train(spark.createDataFrame([], schema), Settings(rounds=2))
    assert empty.rounds == []
    one = boosting.train(spark.createDataFrame([(1, 0, [1.0]), (None, 0, [2.0]), (2, None, [3.0])], schema), Settings(rounds=2))
    assert all(nested(t) == 0.0 or isinstance(nested(t), float) for r in one.rounds for t in r)
    ties = spark.createDataFrame([(i, i % 2, [1.0, None]) for i in range(40)], schema)
    model = boosting.train(ties, Settings(rounds=2))
    assert {r["prediction_index"] for r in model.transform(ties).collect()} == {0.0}


def test_save_and_load(spark, tmp_path):
    df = spark.createDataFrame(table(2), "id bigint, label_index int, features array<double>")
    model = boosting.train(df, Settings(rounds=3, depth=3))
    model.save(spark, str(tmp_path / "m"))
    again = boosting.BoostedTrees.load(spark, str(tmp_path / "m"))
    assert again.settings == model.settings and again.edges == model.edges
    assert [[nested(t) for t in r] for r in again.rounds] == [[nested(t) for t in r] for r in model.rounds]


def test_search_keeps_the_best_of_the_nine_parameter_grid(spark):
    full = boosting.draw_settings()
    assert len(set(full)) == boosting.SEARCH_DRAWS and len(boosting.SEARCH_SPACE) == 9
    df = spark.createDataFrame(table(7, 240), "id bigint, label_index int, features array<double>")
    folded = sampling.stratified_folds(df, "label_index", "id", 2)
    space = boosting.SEARCH_SPACE | {"rounds": [1, 6], "depth": [1, 3]}
    found = boosting.search(folded, boosting.draw_settings(space, 3, 1), folds=2)
    assert found.best == found.draws[found.scores.index(max(found.scores))] and len(found.model.rounds) == found.best.rounds
    assert max(found.scores) > 0.6


def test_accuracy(spark):
    rng = random.Random(3)
    rows = [(i, f"c{i % 3}", [rng.gauss(4.0 * (i % 3 == k), 1.0) for k in range(3)]) for i in range(360)]
    encoded, encoder = learn.encode_labels(spark.createDataFrame(rows, "id bigint, label string, features array<double>"))
    split = sampling.stratified_split(encoded, "label", "id").cache()
    model = boosting.train(split.filter("split = 'train'"), Settings(rounds=10, depth=3))
    scored = learn.decode_labels(model.transform(split.filter("split = 'test'")), encoder)
    assert scored.agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0] >= 0.93
