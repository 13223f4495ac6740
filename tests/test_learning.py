"""Classifiers on separable rows, and principal components."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainlens.operators import learn, sampling


@pytest.fixture(scope="module")
def separable(spark):
    rng = random.Random(3)
    rows = [(i, f"c{i % 3}", [rng.gauss(4.0 * (i % 3 == k), 1.0) for k in range(3)]) for i in range(360)]
    encoded, encoder = learn.encode_labels(spark.createDataFrame(rows, "id bigint, label string, features array<double>"))
    return learn.as_ml_frame(sampling.stratified_split(encoded, "label", "id")).cache(), encoder


@pytest.mark.parametrize("build,settings", [(learn.logistic, (100,)), (learn.linear_svm, (30,))])
def test_held_out_accuracy(separable, build, settings):
    rows, encoder = separable
    model = build(*settings).fit(rows.filter("split = 'train'"))
    scored = learn.decode_labels(model.transform(rows.filter("split = 'test'")), encoder)
    assert scored.agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0] >= 0.93


def test_two_components_carry_the_largest_variances(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(300, 5)) @ np.diag([5.0, 3.0, 1.0, 0.5, 0.1]) + 7.0
    found = learn.pca(spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id bigint, embedding array<double>"), k=2)
    made = np.array([r["components"] for r in found.orderBy("id").collect()])
    values, axes = np.linalg.eigh(np.cov(points.T))
    expect = (points - points.mean(axis=0)) @ axes[:, [-1, -2]]
    assert np.allclose(np.abs(made), np.abs(expect), atol=1e-8) and np.allclose(made.var(axis=0, ddof=1), values[[-1, -2]])
    assert np.allclose(made.mean(axis=0), 0.0, atol=1e-8)
