"""Prediction quality from long class probabilities (id, label, class, p)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ranking import running_sum
from .relational import top_n, value_share


def top_k_per_row(probs: DataFrame, k: int) -> DataFrame:
    """(id, top): the ``k`` most likely classes, best first; among equals the later class comes first."""
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("p", "class"))))
    return probs.groupBy("id").agg(F.slice(ordered, 1, k).alias("_top")).select("id", F.col("_top.class").alias("top"))


def argmax(probs: DataFrame) -> DataFrame:
    """(id, prediction): the most likely class; the first class wins a tie."""
    best = F.min(F.struct((-F.col("p")).alias("_order"), "class"))
    return probs.groupBy("id").agg(best.alias("_best")).select("id", F.col("_best.class").alias("prediction"))


def prediction_frame(probs: DataFrame, k: int = 3) -> DataFrame:
    """One row per sample: prediction, confidences, top-1 and top-k hits, Brier score, cross entropy.

    ``known_label`` is false when the label is no class of the model; its scores are then null.
    """
    best = F.min(F.struct((-F.col("p")).alias("_order"), "class"))
    is_label = F.col("class") == F.col("label")
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("p", "class"))))
    gap = F.col("p") - F.when(is_label, F.lit(1.0)).otherwise(F.lit(0.0))
    rows = probs.groupBy("id", "label").agg(
        best.alias("_best"), F.max(F.when(is_label, F.col("p"))).alias("correct_confidence"),
        F.slice(ordered, 1, k).alias("_top"), F.avg(gap * gap).alias("_brier"), F.count("*").alias("n_class"),
    )
    known = F.col("correct_confidence").isNotNull()
    return rows.select(
        "id", "label", F.col("_best.class").alias("prediction"),
        (-F.col("_best._order")).alias("predicted_confidence"), "correct_confidence",
        (F.col("_best.class") == F.col("label")).alias("correct"),
        F.array_contains(F.col("_top.class"), F.col("label")).alias("top_k_correct"),
        F.when(known, F.col("_brier")).alias("brier"),
        (-F.ln(F.col("correct_confidence") + F.lit(1e-12))).alias("cross_entropy"),
        known.alias("known_label"), "n_class",
    )


def accuracy_by_label(frame: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    chosen = frame if labels is None else frame.filter(F.col("label").isin(list(labels)))
    return chosen.groupBy("label").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"))


def top_k_accuracy(frame: DataFrame) -> DataFrame:
    return frame.agg(F.avg(F.col("top_k_correct").cast("double")).alias("top_k_accuracy"))


def metrics_summary(frame: DataFrame, sample: str, core: Sequence[str]) -> DataFrame:
    """Means of the per-sample scores for all labels and for the core labels, with the 1 / n baseline.

    One pass: every row feeds the ALL scope and, when its label is core, the CORE scope too.
    """
    scopes = F.when(F.col("label").isin(list(core)), F.array(F.lit("ALL"), F.lit("CORE"))).otherwise(F.array(F.lit("ALL")))
    means = {
        "top1_acc": F.col("correct").cast("double"), "topk_acc": F.col("top_k_correct").cast("double"),
        "mean_brier": F.col("brier"), "mean_cross_entropy": F.col("cross_entropy"),
    }
    summed = frame.withColumn("scope", F.explode(scopes)).groupBy("scope").agg(
        *[F.avg(column).alias(name) for name, column in means.items()], F.max("n_class").alias("_classes")
    )
    classes = F.when(F.col("scope") == "CORE", F.lit(len(core))).otherwise(F.col("_classes")).cast("bigint")
    return summed.withColumn("sample", F.lit(sample)).withColumn("n_class", classes).withColumn(
        "random_baseline", F.lit(1.0) / F.col("n_class")
    ).drop("_classes")


def prediction_distribution(frame: DataFrame, core: Sequence[str]) -> DataFrame:
    """(predicted_country, share) among predictions inside the core set."""
    inside = frame.filter(F.col("prediction").isin(list(core)))
    return value_share(inside, "prediction", 1.0).withColumnRenamed("prediction", "predicted_country")


def confusion_matrix(frame: DataFrame, normalize: bool = False) -> DataFrame:
    """(label, prediction, n), with n as a share of the label's rows when ``normalize``."""
    counts = frame.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    if not normalize:
        return counts
    totals = counts.groupBy("label").agg(F.sum("n").alias("_total"))
    return counts.join(totals, "label").select("label", "prediction", (F.col("n") / F.col("_total")).alias("n"))


def classification_report(frame: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support) per class plus macro avg, weighted avg and accuracy rows.

    Everything after the confusion counts works on classes, not on samples.
    """
    counts = confusion_matrix(frame)
    zero = F.lit(0).cast("bigint")
    legs = F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), zero.alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(zero).alias("hit")),
        F.struct(F.col("prediction").alias("class"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("hit")),
    ))
    sums = counts.select(legs.alias("leg")).select("leg.*").groupBy("class").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "hit")]
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    scored = sums.withColumn("precision", ratio(F.col("hit"), F.col("predicted"))).withColumn(
        "recall", ratio(F.col("hit"), F.col("support"))
    ).withColumn("f1", ratio(2 * F.col("hit"), F.col("predicted") + F.col("support")))
    names = ["precision", "recall", "f1"]
    macro = scored.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support"))
    weighted = scored.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names],
                          F.sum("support").alias("support"))
    accuracy = scored.agg((F.sum("hit") / F.sum("support")).alias("accuracy"), F.sum("support").alias("support"))
    accuracy = accuracy.select(*[F.col("accuracy").alias(c) for c in names], "support")
    columns = ["class", *names, "support"]
    result = scored.select(columns)
    for name, part in (("macro avg", macro), ("weighted avg", weighted), ("accuracy", accuracy)):
        result = result.unionByName(part.withColumn("class", F.lit(name)).select(columns))
    return result


def importance_by_feature(attributions: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature over samples and classes."""
    return attributions.groupBy("feature").agg(F.avg(F.abs("value")).alias("importance"))


# First feature and length of each feature block.
FEATURE_BLOCKS = {"graph": (0, 64), "all_hours": (64, 24), "dst_hours": (88, 24), "non_dst_hours": (112, 24)}


def importance_by_group(importance: DataFrame, blocks: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """(block, total, mean, share) per feature block."""
    name = F.lit(None).cast("string")
    for block, (start, length) in (blocks or FEATURE_BLOCKS).items():
        name = F.when(F.col("feature").between(start, start + length - 1), F.lit(block)).otherwise(name)
    summed = importance.withColumn("block", name).filter(F.col("block").isNotNull()).groupBy("block").agg(
        F.sum("importance").alias("total"), F.avg("importance").alias("mean")
    )
    everything = importance.agg(F.sum("importance")).scalar()
    return summed.withColumn("share", F.try_divide(F.col("total"), everything))


def top_features(importance: DataFrame, first_k: int = 64, n: int = 10) -> DataFrame:
    return top_n(importance.filter(F.col("feature") < first_k), "importance", n, ["feature"])


def cumulative_share(importance: DataFrame, key: str = "feature", value: str = "importance") -> DataFrame:
    """Running share of the total from the largest value down, ties by ``key``, over unique rows.

    Range partitions of (value, key) are the blocks, so equal or near values are spread too; they are checkpointed before their
    numbers are used. The sums of the earlier partitions have one row per partition.
    """
    order = [F.col(value).desc(), F.col(key)]
    ranged = materialize(importance.repartitionByRange(*order).withColumn("_block", F.spark_partition_id()))
    summed = running_sum(ranged, [], "_block", order, value, "_run", "_total")
    return summed.select(key, value, F.try_divide("_run", "_total").alias("cumulative_share"))


def mean_country_prob(probs: DataFrame) -> DataFrame:
    return probs.groupBy("country").agg(F.avg("prob").alias("prob"))
