"""Prediction quality and feature importance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, relational
from .registry import common, query

CORE = ["NATION_1", "NATION_3", "NATION_5", "NATION_7"]
_CORE = "('NATION_1', 'NATION_3', 'NATION_5', 'NATION_7')"

common("ranked", """
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, class) AS first_rank,
           row_number() OVER (PARTITION BY id ORDER BY p DESC, class DESC) AS last_rank FROM prediction""")
common("frame", """
    SELECT id, label, max(class) FILTER (first_rank = 1) AS prediction, max(p) AS predicted_confidence,
           max(p) FILTER (class = label) AS correct_confidence,
           max(class) FILTER (first_rank = 1) = label AS correct,
           bool_or(last_rank <= 3 AND class = label) AS top_k_correct,
           avg(pow(p - CASE WHEN class = label THEN 1 ELSE 0 END, 2)) AS brier,
           -ln(max(p) FILTER (class = label) + 1e-12) AS cross_entropy, count(*) AS n_class
    FROM ranked GROUP BY id, label""")
common("confusion", "SELECT label, prediction, count(*) AS n FROM frame GROUP BY 1, 2")
common("report", """
    SELECT class, coalesce(hit / nullif(predicted, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall,
           coalesce(2 * hit / nullif(predicted + support, 0), 0) AS f1, support, hit FROM (
      SELECT c.class, coalesce((SELECT sum(n) FROM confusion WHERE label = c.class), 0) AS support,
             coalesce((SELECT sum(n) FROM confusion WHERE prediction = c.class), 0) AS predicted,
             coalesce((SELECT sum(n) FROM confusion WHERE label = c.class AND prediction = c.class), 0) AS hit
      FROM (SELECT label AS class FROM confusion UNION SELECT prediction FROM confusion) c) s""")
common("importance", "SELECT feature, avg(abs(value)) AS importance FROM attribution GROUP BY feature")


def frame_of(t):
    return metrics.prediction_frame(t["prediction"])


def importance_of(t):
    return metrics.importance_by_feature(t["attribution"])


@query("t3_top_k_per_row", """
    SELECT id, string_agg(class, ' ' ORDER BY last_rank) AS top FROM ranked WHERE last_rank <= 3 GROUP BY id""")
def _(t):
    return metrics.top_k_per_row(t["prediction"], 3).select("id", F.array_join("top", " ").alias("top"))


@query("t4_argmax", "SELECT id, class AS prediction FROM ranked WHERE first_rank = 1")
def _(t):
    return metrics.argmax(t["prediction"])


@query("t5_sort_axis", "SELECT DISTINCT class FROM prediction ORDER BY class")
def _(t):
    return relational.sort_axis(t["prediction"], "class")


@query("e1_prediction_frame", """
    SELECT id, label, prediction, round(predicted_confidence, 6) AS predicted_confidence,
           round(correct_confidence, 6) AS correct_confidence, correct FROM frame""")
def _(t):
    return frame_of(t).select(
        "id", "label", "prediction", F.round("predicted_confidence", 6).alias("predicted_confidence"),
        F.round("correct_confidence", 6).alias("correct_confidence"), "correct",
    )


@query("e2_accuracy_by_label", """
    SELECT label, round(avg(CAST(correct AS INTEGER)), 6) AS accuracy FROM frame GROUP BY label""")
def _(t):
    return metrics.accuracy_by_label(frame_of(t)).withColumn("accuracy", F.round("accuracy", 6))


@query("e3_top_k_accuracy", "SELECT round(avg(CAST(top_k_correct AS INTEGER)), 6) AS top_k_accuracy FROM frame")
def _(t):
    return metrics.top_k_accuracy(frame_of(t)).withColumn("top_k_accuracy", F.round("top_k_accuracy", 6))


@query("e4_brier", "SELECT id, round(brier, 6) AS brier FROM frame")
def _(t):
    return frame_of(t).select("id", F.round("brier", 6).alias("brier"))


@query("e5_cross_entropy", "SELECT id, round(cross_entropy, 6) AS cross_entropy FROM frame")
def _(t):
    return frame_of(t).select("id", F.round("cross_entropy", 6).alias("cross_entropy"))


def _scope(name, where, classes):
    return f"""SELECT '{name}' AS scope, 'multiple' AS sample, CAST({classes} AS BIGINT) AS n_class,
        round(avg(CAST(correct AS INTEGER)), 6) AS top1_acc, round(avg(CAST(top_k_correct AS INTEGER)), 6) AS topk_acc,
        round(avg(brier), 6) AS mean_brier, round(avg(cross_entropy), 6) AS mean_cross_entropy,
        round(1.0::DOUBLE / {classes}, 6) AS random_baseline FROM frame {where}"""


@query("e6_metrics_summary", _scope("ALL", "", "max(n_class)") + " UNION ALL "
       + _scope("CORE", f"WHERE label IN {_CORE}", "4"))
def _(t):
    summary = metrics.metrics_summary(frame_of(t), "multiple", CORE)
    rounded = ("top1_acc", "topk_acc", "mean_brier", "mean_cross_entropy", "random_baseline")
    return summary.withColumns({c: F.round(c, 6) for c in rounded})


@query("e7_prediction_distribution", f"""
    SELECT prediction AS predicted_country, round(count(*) / sum(count(*)) OVER (), 6) AS share
    FROM frame WHERE prediction IN {_CORE} GROUP BY 1""")
def _(t):
    return metrics.prediction_distribution(frame_of(t), CORE).withColumn("share", F.round("share", 6))


@query("e8_confusion_matrix", "SELECT label, prediction, n FROM confusion")
def _(t):
    return metrics.confusion_matrix(frame_of(t))


@query("e8_confusion_matrix_normalized", """
    SELECT label, prediction, round(n / sum(n) OVER (PARTITION BY label), 6) AS n FROM confusion""")
def _(t):
    return metrics.confusion_matrix(frame_of(t), True).withColumn("n", F.round("n", 6))


@query("e9_classification_report", """
    SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM report
    UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM report
    UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
      round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM report
    UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6),
      round(sum(hit) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM report""")
def _(t):
    report = metrics.classification_report(frame_of(t))
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("a24_class_counts", "SELECT label, count(*) AS n FROM frame GROUP BY label")
def _(t):
    return relational.class_counts(frame_of(t), "label")


@query("e10_importance_by_feature", "SELECT feature, round(importance, 6) AS importance FROM importance")
def _(t):
    return importance_of(t).select(F.col("feature").cast("bigint").alias("feature"), F.round("importance", 6).alias("importance"))


@query("e11_importance_by_group", """
    SELECT block, round(sum(importance), 6) AS total, round(avg(importance), 6) AS mean,
           round(sum(importance) / sum(sum(importance)) OVER (), 6) AS share
    FROM (SELECT *, CASE WHEN feature < 64 THEN 'graph' WHEN feature < 88 THEN 'all_hours'
                         WHEN feature < 112 THEN 'dst_hours' ELSE 'non_dst_hours' END AS block FROM importance) b GROUP BY 1""")
def _(t):
    groups = metrics.importance_by_group(importance_of(t))
    return groups.withColumns({c: F.round(c, 6) for c in ("total", "mean", "share")})


@query("e12_top_features", """
    SELECT feature, round(importance, 9) AS importance FROM importance WHERE feature < 64
    ORDER BY round(importance, 9) DESC, feature LIMIT 10""")
def _(t):
    importance = importance_of(t).withColumn("importance", F.round("importance", 9))
    return metrics.top_features(importance).withColumn("feature", F.col("feature").cast("bigint"))


@query("w9_cumulative_share", """
    SELECT feature, importance, round(sum(importance) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING)
      / sum(importance) OVER (), 6) AS cumulative_share
    FROM (SELECT feature, round(importance, 9) AS importance FROM importance) r""")
def _(t):
    importance = importance_of(t).withColumn("importance", F.round("importance", 9))
    shares = metrics.cumulative_share(importance)
    return shares.select(F.col("feature").cast("bigint").alias("feature"), "importance",
                         F.round("cumulative_share", 6).alias("cumulative_share"))
