"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from chainlens.plans import spark_queries
from chainlens.plans.registry import Tables
from chainlens.plans.walk_queries import walks_of

HEADLINE = [
    "flagship_out_degree",
    "a1_edge_weights",
    "w2_assign_ids",
    "w1_build_cdf",
    "w5_random_walks_restart",
    "a7_normalize_histogram",
    "a8_distinct_endpoints",
    "j8_label_flow",
    "a10_flow_share",
    "a12_bilateral_net_flow",
    "a19_unique_country_wallets",
    "a22_participation_ratio",
    "j13_match_exchange_traffic",
    "f1_clean_name",
    "f6_match_top",
    "v5_wallet_country",
    "v9_score_multiple_cosine_softmax",
    "w6_capped_split",
    "e9_classification_report",
    "e10_importance_by_feature",
    "m1_skipgram_pairs",
    "m5_export_vectors",
    "m8_train_boosted_trees",
    "m14_random_param_search",
]
WARM_UP = "a1_edge_weights"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if "spark.checkpoint.dir" not in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = spark_queries()
    chosen = sys.argv[1:] or HEADLINE
    run = {name: (lambda name=name: queries[name](spark, sf_dir)) for name in chosen if name in queries}
    if not sys.argv[1:] or "w5_walks_length_40" in chosen:
        run["w5_walks_length_40"] = lambda: walks_of(Tables(spark, sf_dir), length=40)
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.format("noop").mode("overwrite").save()
    queries[WARM_UP](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings = {}
    for name, build in run.items():
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    total = round(sum(timings.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": timings,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
