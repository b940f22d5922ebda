"""Times the headline queries and prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose scale and cores."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from kinfold.plans.catalog import QUERIES

HEADLINE = (
    "per_class_metrics", "auc_ovr", "two_level_report", "manifest_clean", "kfold_assign", "describe_folds", "balanced_weights",
    "weighted_resample", "bootstrap_ci_accuracy", "bootstrap_ci_macro",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.TemporaryDirectory(prefix="bench-")  # intermediate tables; cleared at the end
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{folder.name}").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINE
    QUERIES["confusion_matrix"](spark, sf_dir).collect()  # start the JVM side before timing
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        # Every row is computed and dropped: the time is the query's, not that of moving rows to Python.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    folder.cleanup()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
