"""Logical tables: columns, types and constraints.

Money is DOUBLE and flags are 0/1 INT, as in the operational database.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

LONG, INT, DOUBLE, STRING, TIME = (
    T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampNTZType(),
)


@dataclass(frozen=True)
class TableSpec:
    """Columns in order plus the constraints `contract_audit` checks."""

    name: str
    columns: tuple[tuple[str, T.DataType], ...]
    primary_key: str
    nullable: tuple[str, ...] = ()
    foreign_keys: tuple[tuple[str, str], ...] = ()
    checks: tuple[tuple[str, str], ...] = ()
    defaults: dict[str, str] = field(default_factory=dict)

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, t, True) for n, t in self.columns])

    def not_null(self) -> list[str]:
        return [n for n, _ in self.columns if n not in self.nullable]


# Tables, columns, types, constraints and defaults of the operational database.
TABLES: dict[str, TableSpec] = {
    spec.name: spec
    for spec in (
        TableSpec(
            "customers",
            (("customer_id", LONG), ("full_name", STRING), ("email", STRING), ("birthdate", STRING)),
            primary_key="customer_id",
            nullable=("birthdate",),
        ),
        TableSpec(
            "products",
            (("product_id", LONG), ("product_name", STRING), ("price", DOUBLE), ("cost", DOUBLE)),
            primary_key="product_id",
            defaults={"cost": "0"},
        ),
        TableSpec(
            "shop_orders",
            (("order_id", LONG), ("customer_id", LONG), ("order_datetime", TIME),
             ("order_total", DOUBLE), ("risk_score", DOUBLE)),
            primary_key="order_id",
            foreign_keys=(("customer_id", "customers"),),
            defaults={"order_datetime": "now", "order_total": "0", "risk_score": "50"},
        ),
        TableSpec(
            "order_items",
            (("order_item_id", LONG), ("order_id", LONG), ("product_id", LONG),
             ("quantity", LONG), ("unit_price", DOUBLE), ("line_total", DOUBLE)),
            primary_key="order_item_id",
            foreign_keys=(("order_id", "shop_orders"), ("product_id", "products")),
            checks=(("quantity_positive", "quantity > 0"),),
        ),
        TableSpec(
            "shipments",
            (("shipment_id", LONG), ("order_id", LONG), ("late_delivery", INT)),
            primary_key="shipment_id",
            foreign_keys=(("order_id", "shop_orders"),),
            checks=(("late_delivery_flag", "late_delivery in (0, 1)"),),
            defaults={"late_delivery": "0"},
        ),
        TableSpec(
            "order_predictions",
            (("order_id", LONG), ("late_delivery_probability", DOUBLE), ("predicted_late_delivery", INT),
             ("fraud_probability", DOUBLE), ("predicted_fraud", INT), ("prediction_timestamp", TIME)),
            primary_key="order_id",
            foreign_keys=(("order_id", "shop_orders"),),
            checks=(("predicted_late_delivery_flag", "predicted_late_delivery in (0, 1)"),
                    ("predicted_fraud_flag", "predicted_fraud in (0, 1)")),
            defaults={"late_delivery_probability": "0", "predicted_late_delivery": "0",
                      "fraud_probability": "0", "predicted_fraud": "0"},
        ),
    )
}

REQUESTS = T.StructType([
    T.StructField("request_id", LONG), T.StructField("requested_at", TIME),
    T.StructField("customer_ref", STRING), T.StructField("order_lines", STRING),
])

RUN_LOGS = T.StructType([
    T.StructField("run_id", LONG), T.StructField("exit_code", INT),
    T.StructField("stdout", STRING), T.StructField("stderr", STRING),
])

# The feature order and label of the two trained models.
FRAUD_FEATURES = [
    "risk_score", "num_items", "total_value", "avg_cost", "customer_age", "customer_order_count",
]
FRAUD_LABEL = "is_fraud"
LATE_FEATURES = ["order_total", "num_items", "hour_of_day", "day_of_week"]
LATE_LABEL = "late_delivery"

DEFAULT_RISK_SCORE = 50.0
