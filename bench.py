"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from evitrust.plans import Tables, load_all

HEADLINE = [
    "abstention_curve", "curve_summary", "coverage_target_curve", "score_percentiles", "trust_rows",
    "policy_alpha_sweep", "variant_summary", "classification_scores", "probability_scores",
    "expected_calibration_error", "score_diagnostics", "late_fusion_sweep", "temperature_grid",
    "plausibility_report", "normalize_names", "closest_names", "resolve_names", "set_comparison",
    "entity_summary", "source_cell_medians", "source_priority_cascade", "wide_feature_table",
    "channel_coverage", "log_ratio_concordance", "priority_rule_audit", "stratified_group_folds",
    "nested_calibration_split", "knn_cosine_distance", "knn_class_distance", "dose_response_fit",
    "parse_panels", "detect_tables", "term_mentions", "assign_lines", "panel_from_words",
    "cells_to_long", "imputed_scaled_features", "logistic_out_of_fold",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("evitrust-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    t = Tables(spark, sf_dir)
    t.orders.groupBy("o_orderstatus").count().collect()  # start the executors
    names = sys.argv[1:] or HEADLINE
    times, failed = {}, {}
    for name in names:
        start = time.perf_counter()
        try:
            registry[name].run(t).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        except Exception as error:  # noqa: BLE001
            failed[name] = f"{type(error).__name__}: {str(error)[:200]}"
        spark.catalog.clearCache()
        print(f"{name}: {times.get(name, failed.get(name))}", file=sys.stderr, flush=True)
    out = {"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))


if __name__ == "__main__":
    main()
