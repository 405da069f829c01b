"""Orders of customers: open orders, counts, recent orders, details and overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packhouse.functions.scalars import fulfillment_status, leading_int, number_or_zero
from packhouse.operators.joins import fits_broadcast, lookup_join

RECENT = 5


def shipped_orders(shipments: DataFrame) -> DataFrame:
    """One row per shipped order, reduced before the shuffle however often it was shipped."""
    return shipments.select("order_id").where("order_id is not null").distinct()


def open_orders(orders: DataFrame, shipments: DataFrame) -> DataFrame:
    """Orders without a shipment row."""
    return orders.join(shipped_orders(shipments), "order_id", "left_anti")


def open_orders_for_scoring(orders: DataFrame, shipments: DataFrame, ordered: bool = True) -> DataFrame:
    rows = open_orders(
        orders.select("order_id", "customer_id", F.col("order_datetime").alias("order_timestamp"),
                      number_or_zero("order_total").alias("total_value")),
        shipments)
    return rows.orderBy("order_id") if ordered else rows


def _of_customer(orders: DataFrame, customer_id: int | None) -> DataFrame:
    return orders if customer_id is None else orders.where(F.col("customer_id") == customer_id)


def _rows_per_order(rows: DataFrame, name: str, wanted: DataFrame | None) -> DataFrame:
    """Row count per order. `wanted` limits it to few orders; where those are small enough to
    broadcast, Catalyst moves the filter below the aggregate."""
    counts = rows.groupBy("order_id").agg(F.count(F.lit(1)).alias(name))
    return counts if wanted is None else counts.join(wanted.select("order_id"), "order_id", "left_semi")


def order_counts(orders: DataFrame, items: DataFrame, shipments: DataFrame | None = None,
                 narrow: bool = False) -> DataFrame:
    """Line rows and shipment rows per order, 0 if none. Counted before joining, so that the
    two do not multiply. `narrow` says that `orders` is a small part of all orders."""
    wanted = orders if narrow else None
    result = orders.join(_rows_per_order(items, "item_count", wanted), "order_id", "left")
    counted = ["item_count"]
    if shipments is not None:
        result = result.join(_rows_per_order(shipments, "shipment_count", wanted), "order_id", "left")
        counted.append("shipment_count")
    return result.fillna(0, counted)


def _spend_per_customer(orders: DataFrame) -> DataFrame:
    return orders.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("order_count"),
        F.sum("order_total").alias("total_spend"),
        F.max("order_datetime").alias("last_order_datetime"))


def customer_order_stats(customers: DataFrame, orders: DataFrame, customer_id: int | None = None) -> DataFrame:
    """Order count, spend and last order for every customer, those without orders included."""
    return (
        _of_customer(customers, customer_id).select("customer_id")
        .join(_spend_per_customer(_of_customer(orders, customer_id)), "customer_id", "left")
        .fillna(0, ["order_count"]).fillna(0.0, ["total_spend"])
    )


def customer_order_counts(orders: DataFrame) -> DataFrame:
    return orders.groupBy("customer_id").agg(F.count(F.lit(1)).alias("customer_order_count"))


_ORDER_COLUMNS = ["customer_id", "order_id", "order_datetime", "order_total"]


def _order_columns(orders: DataFrame) -> DataFrame:
    return orders.select("customer_id", "order_id", "order_datetime", number_or_zero("order_total"))


def _newest_first() -> list:
    return [F.col("order_datetime").desc_nulls_last(), F.col("order_id")]


def _latest(orders: DataFrame, n: int) -> DataFrame:
    """The n newest orders of each customer. Each task keeps its n best before the shuffle,
    so that a customer with very many orders sends few."""
    newest = Window.partitionBy("customer_id").orderBy(*_newest_first())
    return _order_columns(orders).withColumn("_rank", F.row_number().over(newest)).where(
        F.col("_rank") <= n)


def customer_orders(orders: DataFrame, items: DataFrame, shipments: DataFrame,
                    customer_id: int | None = None, ordered: bool = True) -> DataFrame:
    """All orders per customer, with line and shipment counts; newest first unless `ordered` is off.

    Leave it off to process or store the table: sorting all orders of all customers is a shuffle of its own.
    """
    chosen = _order_columns(_of_customer(orders, customer_id))
    counted = order_counts(chosen, items, shipments, narrow=customer_id is not None)
    shown = counted.withColumn("status", fulfillment_status(F.col("shipment_count"))).select(
        *_ORDER_COLUMNS, "item_count", "shipment_count", "status")
    return shown.orderBy("customer_id", *_newest_first()) if ordered else shown


def _recent_counted(orders: DataFrame, items: DataFrame, shipments: DataFrame,
                    customer_id: int | None, n: int) -> DataFrame:
    latest = _latest(_of_customer(orders, customer_id), n)
    counted = order_counts(latest, items, shipments, narrow=customer_id is not None)
    return counted.withColumn("status", fulfillment_status(F.col("shipment_count")))


def customer_recent_orders(orders: DataFrame, items: DataFrame, shipments: DataFrame,
                           customer_id: int | None = None, n: int = RECENT) -> DataFrame:
    """The n newest orders per customer."""
    return _recent_counted(orders, items, shipments, customer_id, n).select(
        *_ORDER_COLUMNS, "item_count", "shipment_count", "status").orderBy("customer_id", *_newest_first())


def customer_overview(customers: DataFrame, orders: DataFrame, items: DataFrame, shipments: DataFrame,
                      customer_id: int | None = None, n: int = RECENT) -> DataFrame:
    """One row per customer: identity, order statistics and the n newest orders as an array."""
    recent = _recent_counted(orders, items, shipments, customer_id, n).groupBy("customer_id").agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("_rank").alias("position"), "order_id", "order_datetime", "order_total",
            "item_count", "shipment_count", "status"))).alias("recent_orders"))
    chosen = _of_customer(customers, customer_id).select("customer_id", "full_name", "email")
    return (
        chosen
        .join(_spend_per_customer(_of_customer(orders, customer_id)), "customer_id", "left")
        .join(recent, "customer_id", "left")
        .fillna(0, ["order_count"]).fillna(0.0, ["total_spend"])
        .withColumn("recent_orders", F.coalesce("recent_orders", F.array()))
    )


def order_ownership(claims: DataFrame, orders: DataFrame) -> DataFrame:
    """Whether each (order_ref, customer_id) names an order of that customer.

    `order_ref` is text; a leading number counts.
    """
    owners = orders.select("order_id", F.col("customer_id").alias("_owner"))
    looked_up = lookup_join(
        claims.withColumn("order_id", leading_int(F.col("order_ref"))), "order_id", [(owners, "left")])
    belongs = F.coalesce(F.col("_owner") == F.col("customer_id"), F.lit(False))
    return looked_up.select(*claims.columns, "order_id", belongs.alias("belongs"))


def order_header(claims: DataFrame, orders: DataFrame, items: DataFrame) -> DataFrame:
    """Header and line count for each claim that names the customer's own order."""
    claimed = claims.withColumn("order_id", leading_int(F.col("order_ref")))
    owned = orders.select(
        "order_id", F.col("customer_id").alias("_owner"), "order_datetime", number_or_zero("order_total"))
    few = fits_broadcast(claims)
    if few:
        owned = owned.join(claimed.select("order_id"), "order_id", "left_semi")
    headers = order_counts(owned, items, narrow=few)
    return lookup_join(claimed, "order_id", [(headers, "inner")]).where("_owner = customer_id").select(
        *claims.columns, "order_id", "order_datetime", "order_total", "item_count")


def order_line_items(items: DataFrame, products: DataFrame, order_ids: DataFrame | None = None,
                     ordered: bool = True) -> DataFrame:
    """Lines with product names, by order and line id unless `ordered` is off; lines of unknown products are hidden."""
    if order_ids is not None:
        items = items.join(order_ids.select("order_id").distinct(), "order_id", "left_semi")
    shown = lookup_join(
        items, "product_id", [(products.select("product_id", "product_name"), "inner")]).select(
        "order_id", "order_item_id", "product_name", F.coalesce("quantity", F.lit(0)).alias("quantity"),
        number_or_zero("unit_price"), number_or_zero("line_total"))
    return shown.orderBy("order_id", "order_item_id") if ordered else shown
