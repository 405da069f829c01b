"""The seed rows with "now" fixed at 2026-01-31 00:00:00, and small edge tables."""

import datetime as dt

from packhouse.schemas import REQUESTS, TABLES

NOW = "2026-01-31 00:00:00"

# The seed rows of the operational database.
CUSTOMERS = [
    (1, "Ada Lovelace", "ada@example.edu", "1990-03-10"),
    (2, "Alan Turing", "alan@example.edu", "1985-07-22"),
    (3, "Grace Hopper", "grace@example.edu", "1992-11-01"),
]
PRODUCTS = [
    (1, "Notebook", 4.5, 2.1), (2, "Pen Set", 12.0, 5.0), (3, "Desk Lamp", 29.99, 14.5), (4, "USB Cable", 8.25, 3.0),
]
ORDERS = [
    (1, 1, dt.datetime(2026, 1, 26), 9.0, 38.0),
    (2, 1, dt.datetime(2026, 1, 29), 29.99, 55.0),
    (3, 2, dt.datetime(2026, 1, 30), 8.25, 44.0),
]
ITEMS = [(1, 1, 1, 2, 4.5, 9.0), (2, 2, 3, 1, 29.99, 29.99), (3, 3, 4, 1, 8.25, 8.25)]
SHIPMENTS = [(1, 2, 0)]

ROWS = {
    "customers": CUSTOMERS, "products": PRODUCTS, "shop_orders": ORDERS, "order_items": ITEMS,
    "shipments": SHIPMENTS, "order_predictions": [],
}


def table(spark, name, rows):
    return spark.createDataFrame(rows, TABLES[name].struct)


def tables(spark, **changed):
    return {name: table(spark, name, changed.get(name, rows)) for name, rows in ROWS.items()}


def requests(spark, *pairs):
    """(customer_ref, order_lines) pairs, one minute apart, numbered from 1."""
    start = dt.datetime(2026, 2, 1)
    rows = [(i + 1, start + dt.timedelta(minutes=i), ref, lines) for i, (ref, lines) in enumerate(pairs)]
    return spark.createDataFrame(rows, REQUESTS)


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
