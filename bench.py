"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from terrane.plans import registry

NAMES = ("corpus_frame", "text_features", "zscores", "pairs_matched", "within_between_gap", "class_centroids", "cover_membership", "mapper_edges", "graph_stats", "purity", "pairwise_agreement", "jackknife_se", "feature_rank_correlation", "anchor_rho_uniform", "layers_two_and_three", "checkpoint_evaluation", "graph_stats_density", "duplicate_free_batches", "upsert_results", "fig_rho_vs_step", "roster_order")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.queries()["split_counts"](spark, sf_dir).collect()  # starts the session's threads
    took = {}
    for name in NAMES:
        began = time.time()
        registry.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
