"""Feature tables for the two models, and their summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packhouse.functions.scalars import as_number, customer_age
from packhouse.operators.joins import lookup_join, narrow, settled
from packhouse.operators.orders import customer_order_counts, open_orders
from packhouse.operators.quantiles import exact_quantiles
from packhouse.schemas import FRAUD_FEATURES, FRAUD_LABEL, LATE_LABEL
from packhouse.sources.shared import materialize

Tables = Mapping[str, DataFrame]


def item_aggregates_serving(items: DataFrame, products: DataFrame) -> DataFrame:
    """Per order: quantity, value and mean product cost over lines. Lines of unknown products drop out."""
    costed = lookup_join(items, "product_id", [(narrow(products.select("product_id", "cost")), "inner")])
    return costed.groupBy("order_id").agg(
        F.sum("quantity").alias("num_items"), F.sum("line_total").alias("total_value"),
        F.avg("cost").alias("avg_cost"))


def item_aggregates_training(items: DataFrame, products: DataFrame) -> DataFrame:
    """As for serving, plus mean unit price; lines of unknown products count, only their cost is skipped."""
    costed = lookup_join(items, "product_id", [(narrow(products.select("product_id", "cost")), "left")])
    return costed.where("order_id is not null").groupBy("order_id").agg(
        F.coalesce(F.sum("quantity"), F.lit(0)).alias("num_items"),
        F.avg("unit_price").alias("avg_unit_price"),
        F.coalesce(F.sum("line_total"), F.lit(0.0)).alias("total_value"),
        F.avg("cost").alias("avg_cost"))


def _as_numbers(columns: Sequence[str]) -> list:
    return [as_number(c).alias(c) for c in columns]


def _customer_facts(tables: Tables, counts: DataFrame, how: str) -> DataFrame:
    """Birthdate and order count of each customer, as one table: orders look it up once, so that a customer with very many
    orders is a plain skewed join."""
    born = tables["customers"].select("customer_id", "birthdate")
    return settled(born.join(counts, "customer_id", how), born, "customers")


def fraud_features_serving(tables: Tables) -> DataFrame:
    """The six features for every open order whose customer is known.

    Without lines, num_items is 0 and both total_value and avg_cost fall back to the order total.
    """
    orders = tables["shop_orders"]
    waiting = open_orders(
        orders.select("order_id", "customer_id", "order_datetime", "order_total", "risk_score"),
        tables["shipments"])
    # Open orders are partitioned by order here, as are the line aggregates.
    with_items = waiting.join(
        item_aggregates_serving(tables["order_items"], tables["products"]), "order_id", "left")
    described = lookup_join(with_items, "customer_id", [(_customer_facts(tables, customer_order_counts(orders), "left"), "inner")])
    total = F.col("order_total")
    return described.select(
        "order_id", "risk_score",
        F.coalesce("num_items", F.lit(0)).alias("num_items"),
        F.coalesce(F.col("total_value"), total).alias("total_value"),
        F.coalesce(F.col("avg_cost"), total).alias("avg_cost"),
        customer_age(F.col("order_datetime"), F.col("birthdate")).alias("customer_age"),
        F.coalesce("customer_order_count", F.lit(1)).alias("customer_order_count"),
    ).select("order_id", *_as_numbers(FRAUD_FEATURES))


def fraud_features_training(tables: Tables, strict_dates: bool = False) -> DataFrame:
    """The six features and the label for all orders; nothing is filled in.

    `strict_dates` stops on a birthdate that is no date instead of leaving the age null.
    """
    orders = tables["shop_orders"]
    with_items = orders.join(
        item_aggregates_training(tables["order_items"], tables["products"]), "order_id", "left")
    # Counted over the orders themselves: a customer missing from the directory has a count too.
    counts = orders.where("customer_id is not null").groupBy("customer_id").agg(
        F.count("order_id").alias("customer_order_count"))
    described = lookup_join(with_items, "customer_id", [(_customer_facts(tables, counts, "full_outer"), "left")])
    born = F.col("birthdate").cast("timestamp_ntz") if strict_dates else F.col("birthdate")
    return described.withColumn("customer_age", customer_age(F.col("order_datetime"), born)).select(
        "order_id", *_as_numbers(FRAUD_FEATURES), F.col(FRAUD_LABEL).cast("int").alias(FRAUD_LABEL))


def late_delivery_features(tables: Tables) -> DataFrame:
    """One row per shipment: order total, item count, hour and weekday (Monday 0), late or not."""
    quantities = tables["order_items"].groupBy("order_id").agg(F.sum("quantity").alias("num_items"))
    orders = tables["shop_orders"].select("order_id", "order_total", "order_datetime").join(
        quantities, "order_id", "left")
    shipments = tables["shipments"]
    key = ["shipment_id"] if "shipment_id" in shipments.columns else []
    return lookup_join(
        shipments.select(*key, "order_id", LATE_LABEL), "order_id", [(orders, "inner")]).select(
        *key, "order_id", "order_total",
        F.coalesce("num_items", F.lit(0)).alias("num_items"),
        F.hour("order_datetime").alias("hour_of_day"),
        F.weekday("order_datetime").alias("day_of_week"),
        F.col(LATE_LABEL).cast("int").alias(LATE_LABEL))


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """Share of each label value among non-null labels, largest first."""
    labeled = df.where(F.col(label).isNotNull())
    total = labeled.agg(F.count(F.lit(1))).scalar()
    return labeled.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("_n")).select(
        "label", (F.col("_n") / total).alias("share")).orderBy(F.desc("share"), "label")


def feature_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles, one row per column. NaN counts as missing."""
    df = materialize(df.select(*columns), "summary")
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    measures = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]

    def measured(c: str) -> F.Column:
        q25, q50, q75 = quartiles[c]
        number = as_number(c)
        return F.struct(
            F.lit(c).alias("feature"), F.count(number).alias("count"), F.avg(number).alias("mean"),
            F.stddev_samp(number).alias("std"), F.min(number).alias("min"),
            F.lit(q25).cast("double").alias("p25"), F.lit(q50).cast("double").alias("p50"),
            F.lit(q75).cast("double").alias("p75"), F.max(number).alias("max"))

    one_row = df.agg(*[measured(c).alias(f"_{i}") for i, c in enumerate(columns)])
    return one_row.select(F.explode(F.array(*one_row.columns)).alias("s")).select(
        "s.feature", *[f"s.{m}" for m in measures])
