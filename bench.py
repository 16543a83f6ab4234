"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import importlib.util
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from terrane import queries as core

HEADLINES = ["discretize_kmeans", "embedding_scale_value", "kde_scaled", "region_membership_kde", "region_purity", "shared_pct_max", "score_overlap", "mean_ranks", "interval_overlap_open", "knn_graph", "radius_graph", "graph_components", "bbox_square", "region_annotations", "contrastive", "descriptive"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    todo = {n: core.queries()[n] for n in HEADLINES}
    if importlib.util.find_spec("terrane.llm") is not None:
        from terrane.llm import queries as llm

        todo |= llm.queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name, fn in todo.items():
        began = time.time()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
