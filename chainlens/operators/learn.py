"""Embedding and classifier training with Spark ML."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.ml import Estimator
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import PCA, IndexToString, StandardScaler, StringIndexer, StringIndexerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .relational import label_or_other


def assemble_features(
    ens_truth: DataFrame, early_truth: DataFrame, vectors: DataFrame, profiles: DataFrame, targeted: Sequence[str]
) -> DataFrame:
    """(address, origin, label, features[136]): graph vector followed by hour profile.

    An address known from both origins appears twice; one without a vector or a profile drops out.
    """
    truth = ens_truth.select("address", "country", F.lit("ens").alias("origin")).unionByName(
        early_truth.select("address", "country", F.lit("early").alias("origin"))
    )
    joined = truth.join(vectors.select("address", "embedding"), "address").join(
        profiles.select("address", "profile"), "address"
    )
    return joined.select(
        "address", "origin", label_or_other("country", targeted).alias("label"),
        F.concat(F.col("embedding").cast("array<double>"), F.col("profile").cast("array<double>")).alias("features"),
    )


def export_vectors(vectors: DataFrame) -> DataFrame:
    """(id, embedding) in single precision, as they are written for later use."""
    return vectors.select(F.col("id").cast("bigint").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))


def encode_labels(df: DataFrame, label: str = "label", out: str = "label_index") -> tuple[DataFrame, StringIndexerModel]:
    """Class index in alphabetical order of the labels, and the fitted encoder."""
    encoder = StringIndexer(inputCol=label, outputCol=out, stringOrderType="alphabetAsc").fit(df)
    return encoder.transform(df), encoder


def decode_labels(df: DataFrame, encoder: StringIndexerModel, column: str = "prediction_index", out: str = "prediction") -> DataFrame:
    return IndexToString(inputCol=column, outputCol=out, labels=encoder.labels).transform(df)


def as_ml_frame(df: DataFrame, features: str = "features") -> DataFrame:
    """Array features as an ML vector column."""
    return df.withColumn(features, array_to_vector(F.col(features).cast("array<double>")))


_COMMON = {"featuresCol": "features", "labelCol": "label_index", "predictionCol": "prediction_index"}


def logistic(max_iter: int = 2000) -> Estimator:
    return LogisticRegression(family="multinomial", maxIter=max_iter, **_COMMON)


def linear_svm(max_iter: int = 100) -> Estimator:
    return OneVsRest(classifier=LinearSVC(featuresCol="features", labelCol="label_index", maxIter=max_iter), **_COMMON)


def pca(df: DataFrame, k: int = 2, vector: str = "embedding", out: str = "components") -> DataFrame:
    """Adds the ``k`` principal components of the centred vectors as an array."""
    ready = df.withColumn("_raw", array_to_vector(F.col(vector).cast("array<double>")))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="_raw", outputCol="_centred").fit(ready).transform(ready)
    model = PCA(k=k, inputCol="_centred", outputCol="_components").fit(centred)
    return model.transform(centred).withColumn(out, vector_to_array("_components")).drop("_raw", "_centred", "_components")


def save_classifier(spark: SparkSession, model: BoostedTrees, encoder: StringIndexerModel, path: str) -> None:
    """The model, its label encoder and its parameters, each in a folder of its own below ``path``."""
    model.save(spark, f"{path}/model")
    encoder.write().overwrite().save(f"{path}/label_encoder")
    best = json.dumps(asdict(model.settings), indent=2)
    spark.createDataFrame([(best,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/best_params")


def load_classifier(spark: SparkSession, path: str) -> tuple[BoostedTrees, StringIndexerModel, dict]:
    """(model, encoder, parameters) as saved."""
    best = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/best_params", wholetext=True).collect()))
    return BoostedTrees.load(spark, f"{path}/model"), StringIndexerModel.load(f"{path}/label_encoder"), best
