"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data (default sf0.1), BENCH_CPUS the cores (default 8). Each query
writes to the no-op sink, so that every row and column is produced and none reaches the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

from packhouse.plans.registry import queries
from packhouse.session import build_session

HEADLINE = [
    "warehouse_priority_queue", "fraud_flagged_open_orders", "open_orders_for_scoring", "customer_order_stats",
    "customer_recent_orders", "customer_orders", "customer_overview", "order_ownership", "order_header",
    "order_line_items", "customer_search", "customer_search_table", "customer_resolve",
    "item_aggregates_serving", "item_aggregates_training", "fraud_features_serving", "fraud_features_training",
    "late_delivery_features", "feature_summary", "stratified_split", "median_impute", "standard_scale",
    "balanced_weights", "binary_metrics", "classification_report", "fit_logistic", "late_delivery_evaluate",
    "hash_score", "score_open_orders_hash", "score_open_orders_model", "upsert_predictions", "scoring_run",
    "order_lines_parse", "order_intake", "place_orders", "cart_preview", "intake_stream",
    "contract_audit", "table_profile", "run_log_summary",
    "customers_list", "products_list", "customer_resolve_session", "product_price", "open_orders", "fulfillment_status",
    "order_counts", "customer_order_counts", "label_distribution", "customer_age", "model_card", "model_smoke_check",
    "scoring_run_summary", "daily_scoring", "customer_order_stats_maintained", "customer_order_counts_maintained",
    "order_counts_maintained", "scoring_by_change",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "packhouse-bench", spark__master=f"local[{cores}]", spark__sql__shuffle__partitions=cores,
        spark__ui__enabled="false", spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"))
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    chosen = sys.argv[1:] or HEADLINE
    # Starts the JVM's compilers.
    run("warehouse_priority_queue")
    times = {name: run(name) for name in chosen}
    print(json.dumps({
        "metric": "total time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cores": int(cores),
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
