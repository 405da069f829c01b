"""Storing the operational tables so that joins by order move no data."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from packhouse.schemas import TABLES

# Tables joined and counted by order share one bucketing; the others are looked up by their key.
BUCKET_KEYS = {
    "shop_orders": "order_id", "order_items": "order_id", "shipments": "order_id", "order_predictions": "order_id",
    "customers": "customer_id", "products": "product_id",
}


def save_bucketed(tables: Mapping[str, DataFrame], database: str, buckets: int) -> None:
    """Write catalog tables bucketed and sorted by key.

    Line and shipment counts, the open-order test and the prediction join then run bucket by
    bucket without a shuffle. Choose `buckets` so that one bucket of the largest table fits a task
    (about 1 GB); every table by order needs the same number. Rows are shuffled into buckets
    first, so that each bucket is one file.
    """
    for name, table in tables.items():
        key = BUCKET_KEYS[name]
        table.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(
            buckets, key).sortBy(key).saveAsTable(f"{database}.{name}")


def load_bucketed(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    return {name: spark.table(f"{database}.{name}") for name in TABLES}
