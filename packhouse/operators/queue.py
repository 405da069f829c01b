"""Which open orders to look at first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packhouse.functions.scalars import clean_name, number_or_zero, time_text
from packhouse.operators.joins import lookup_join
from packhouse.operators.orders import open_orders

QUEUE_SIZE = 50


def warehouse_priority_queue(orders: DataFrame, customers: DataFrame, shipments: DataFrame,
                             predictions: DataFrame, limit: int = QUEUE_SIZE) -> DataFrame:
    """Open orders, scored ones first, then by fraud and late probability, then oldest first.

    A scored 0.0 outranks an order without a score. Scores are joined while the open orders
    are still partitioned by order, and the ranking is a top-k, not a full sort. Names are looked up for its rows only.
    """
    scores = predictions.select(
        "order_id", F.lit(1).alias("_scored"), "late_delivery_probability", "predicted_late_delivery",
        "fraud_probability", "predicted_fraud", time_text(F.col("prediction_timestamp")).alias("_scored_at"))
    waiting = open_orders(
        orders.select("order_id", "customer_id", "order_datetime", "order_total"), shipments
    ).join(scores, "order_id", "left")
    known = lookup_join(
        waiting, "customer_id", [(customers.select("customer_id"), "left_semi")])
    queue = known.select(
        "order_id", "order_datetime", number_or_zero("order_total"), "customer_id",
        F.coalesce("_scored", F.lit(0)).alias("has_prediction"),
        F.coalesce("late_delivery_probability", F.lit(0.0)).alias("late_delivery_probability"),
        F.coalesce("predicted_late_delivery", F.lit(0)).alias("predicted_late_delivery"),
        F.coalesce("fraud_probability", F.lit(0.0)).alias("fraud_probability"),
        F.coalesce("predicted_fraud", F.lit(0)).alias("predicted_fraud"),
        F.coalesce("_scored_at", F.lit("")).alias("prediction_timestamp"))
    ranking = [F.desc("has_prediction"), F.desc("fraud_probability"), F.desc("late_delivery_probability"),
               F.col("order_datetime").asc_nulls_last(), "order_id"]
    first = queue.orderBy(*ranking).limit(limit)
    names = customers.select("customer_id", clean_name(F.col("full_name")).alias("customer_name"))
    # `first` has at most `limit` rows.
    return names.join(F.broadcast(first), "customer_id").select(
        *first.columns[:4], "customer_name", *first.columns[4:]).orderBy(*ranking).limit(limit)


def fraud_flagged_open_orders(orders: DataFrame, customers: DataFrame, shipments: DataFrame,
                              predictions: DataFrame) -> DataFrame:
    """Open orders whose prediction flags fraud, most probable first."""
    flagged = predictions.where("predicted_fraud = 1").select("order_id", "fraud_probability")
    waiting = open_orders(
        orders.select("order_id", "customer_id", "order_total").join(flagged, "order_id"), shipments)
    names = customers.select("customer_id", clean_name(F.col("full_name")).alias("customer_name"))
    return lookup_join(waiting, "customer_id", [(names, "inner")]).select(
        "order_id", number_or_zero("order_total"), "customer_name", "fraud_probability"
    ).orderBy(F.col("fraud_probability").desc_nulls_last(), "order_id")
