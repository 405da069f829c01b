"""The logical tables as views over the star-schema test tables (see FIXTURES.md)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packhouse.functions.scalars import hash_score_at
from packhouse.operators.joins import lookup_join
from packhouse.operators.numbering import number_rows

# The columns used of each test table; a declared schema saves a job that would read it from the files.
COLUMNS = {
    "customer": "c_custkey bigint, c_name string",
    "part": "p_partkey bigint, p_name string, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
                " l_extendedprice double, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string",
    "documents": "doc_id bigint, text string",
}

# Lines of one order are told apart by these columns; rows equal in all of them are copies.
LINE_ORDER = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_shipdate", "l_linestatus",
]


def _case(*branches: tuple[Column, Column], otherwise: Column) -> Column:
    column = F.when(*branches[0])
    for condition, value in branches[1:]:
        column = column.when(condition, value)
    return column.otherwise(otherwise)


class StarTables:
    """Lazily built logical tables; a query pays only for the ones it names."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(COLUMNS[name]).parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def customers(self) -> DataFrame:
        key = F.col("c_custkey")
        birthdate = _case(
            (key % 50 == 0, F.lit(None).cast("string")),
            (key % 97 == 0, F.lit("unknown")),
            otherwise=F.concat_ws(
                "-", (1950 + key % 50).cast("string"),
                F.lpad((1 + key % 12).cast("string"), 2, "0"), F.lpad((1 + key % 28).cast("string"), 2, "0")),
        )
        return self.raw("customer").select(
            (key + 1).alias("customer_id"),
            F.col("c_name").alias("full_name"),
            F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.edu")).alias("email"),
            birthdate.alias("birthdate"),
        )

    @cached_property
    def products(self) -> DataFrame:
        share = (30 + (F.col("p_partkey") % 5) * 10) / F.lit(100.0)
        return self.raw("part").select(
            (F.col("p_partkey") + 1).alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_retailprice").alias("price"),
            (F.col("p_retailprice") * share).alias("cost"),
        )

    @cached_property
    def labeled_orders(self) -> DataFrame:
        key = F.col("o_orderkey")
        seconds = ((key * 7919) % 86400).cast("int")
        risk = (key * 31 + 17) % 101
        return self.raw("orders").select(
            (key + 1).alias("order_id"),
            (F.col("o_custkey") + 1).alias("customer_id"),
            (F.col("o_orderdate") + F.make_dt_interval(secs=seconds)).alias("order_datetime"),
            F.col("o_totalprice").alias("order_total"),
            risk.cast("double").alias("risk_score"),
            F.when(risk + (key * 7919 + 13) % 61 >= 130, 1).otherwise(0).alias("is_fraud"),
        )

    @cached_property
    def shop_orders(self) -> DataFrame:
        return self.labeled_orders.drop("is_fraud")

    def _item_columns(self) -> list[Column]:
        return [
            (F.col("l_orderkey") + 1).alias("order_id"),
            (F.col("l_partkey") + 1).alias("product_id"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
            F.col("l_extendedprice").alias("line_total"),
        ]

    @cached_property
    def items(self) -> DataFrame:
        """Order lines without their ids, which most queries do not need."""
        return self.raw("lineitem").select(*self._item_columns())

    @cached_property
    def _numbered_lines(self) -> DataFrame:
        """The lines with ids 1..n: a sort of the whole table, done by each query that needs the ids."""
        return number_rows(self.raw("lineitem").select(*LINE_ORDER), LINE_ORDER, "line_id")

    @cached_property
    def order_items(self) -> DataFrame:
        return self._numbered_lines.select(F.col("line_id").alias("order_item_id"), *self._item_columns())

    @cached_property
    def shipped(self) -> DataFrame:
        """order_id of every shipment row: all that open/shipped questions need."""
        return self.raw("lineitem").where("l_linestatus = 'F'").select((F.col("l_orderkey") + 1).alias("order_id"))

    @cached_property
    def shipments(self) -> DataFrame:
        dates = self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
        lines = self._numbered_lines.where("l_linestatus = 'F'").select("line_id", "l_orderkey", "l_shipdate")
        late = F.col("l_shipdate") > F.col("o_orderdate") + F.expr("interval 700 days")
        return lookup_join(lines, "l_orderkey", [(dates, "inner")]).select(
            F.col("line_id").alias("shipment_id"),
            (F.col("l_orderkey") + 1).alias("order_id"),
            F.when(late, 1).otherwise(0).alias("late_delivery"),
        )

    @cached_property
    def order_predictions(self) -> DataFrame:
        """Predictions of an earlier run, partly for orders shipped since."""
        score = hash_score_at(
            F.col("order_id"), F.col("customer_id"), F.col("order_total"), F.col("order_datetime"))
        late = (F.col("order_id") * 13) % 1000
        return (
            self.shop_orders.where("order_id % 3 <> 0")
            .select("order_id", (late / F.lit(1000.0)).alias("late_delivery_probability"),
                    F.when(late >= 500, 1).otherwise(0).alias("predicted_late_delivery"),
                    score.alias("fraud_probability"),
                    F.when(score >= 0.5, 1).otherwise(0).alias("predicted_fraud"),
                    F.lit("2002-01-01 00:00:00").cast("timestamp_ntz").alias("prediction_timestamp"))
        )

    @cached_property
    def order_requests(self) -> DataFrame:
        k = F.col("event_id")
        user = (F.col("user_id") + 1).cast("string")

        def line(product: Column, quantity: str | Column) -> Column:
            return F.concat(F.lit('{"product_id":'), product.cast("string"), F.lit(',"quantity":'),
                            quantity if isinstance(quantity, Column) else F.lit(quantity), F.lit("}"))

        def payload(*lines: Column) -> Column:
            return F.concat(F.lit("["), F.concat_ws(",", *lines), F.lit("]"))

        product = k % 200 + 1
        quoted = F.concat(F.lit('"'), product.cast("string"), F.lit('"'))
        return self.raw("events").where("event_type = 'purchase'").select(
            (k + 1).alias("request_id"),
            F.col("ts").alias("requested_at"),
            _case((k % 23 == 0, F.lit("abc")), (k % 29 == 0, F.lit("0")), (k % 31 == 0, F.lit("99999999")),
                  otherwise=user).alias("customer_ref"),
            _case(
                (k % 13 == 0, F.lit("[]")),
                (k % 17 == 0, F.lit("not json")),
                (k % 19 == 0, payload(line(product, "0"))),
                (k % 37 == 0, payload(line(F.lit(99999999), "1"))),
                (k % 41 == 0, F.lit('[{"product_id":1,"quantity":1},5]')),
                (k % 7 == 0, payload(line(quoted, '"2abc"'))),
                otherwise=payload(line(product, (k % 5 + 1).cast("string")), line((k * 3) % 200 + 1, "1.9")),
            ).alias("order_lines"),
        )

    @cached_property
    def run_logs(self) -> DataFrame:
        """One captured job run per document: its text, followed by one of six kinds of report."""
        k = F.col("doc_id")
        n = (k % 1000).cast("string")
        report = _case(
            (k % 6 == 0, F.concat(F.lit("\nRESULT orders_scored="), n, F.lit("\nRESULT fraud_flagged_ids="),
                                  (k + 1).cast("string"), F.lit(","), (k + 2).cast("string"), F.lit("\n"))),
            (k % 6 == 1, F.concat(F.lit("\nOrders Scored : "), n)),
            (k % 6 == 2, F.concat(F.lit("\nscored "), n, F.lit(" orders"))),
            (k % 6 == 3, F.concat(F.lit("\nRESULT  orders_scored="), n, F.lit("\nRESULT fraud_flagged_ids="))),
            otherwise=F.lit(""),
        )
        return self.raw("documents").select(
            (k + 1).alias("run_id"),
            F.when(k % 5 == 0, 1).otherwise(0).alias("exit_code"),
            F.concat("text", report).alias("stdout"),
            F.when(k % 6 == 4, F.concat(F.lit("orders-scored = "), n)).otherwise(F.lit("")).alias("stderr"),
        )

    @cached_property
    def predictions_labeled(self) -> DataFrame:
        """Labels with a probability that is not a model's: input for the metric operators."""
        score = hash_score_at(
            F.col("order_id"), F.col("customer_id"), F.col("order_total"), F.col("order_datetime"))
        return self.labeled_orders.select(
            F.col("order_id").alias("id"), F.col("is_fraud").alias("label"), score.alias("prob"),
        ).withColumn("pred", F.when(F.col("prob") > 0.5, 1).otherwise(0))

    @cached_property
    def order_claims(self) -> DataFrame:
        """Order numbers as typed by customers; some are not theirs, some are no numbers."""
        k = F.col("o_orderkey")
        return self.raw("orders").select(
            k.alias("claim_id"),
            _case((k % 7 == 0, F.concat(F.lit("x"), k.cast("string"))),
                  (k % 11 == 0, F.concat(F.lit(" "), (k + 1).cast("string"), F.lit("abc"))),
                  otherwise=(k + 1).cast("string")).alias("order_ref"),
            F.when(k % 5 == 0, F.col("o_custkey") + 2).otherwise(F.col("o_custkey") + 1).alias("customer_id"),
        )

    def operational(self, with_label: bool = False) -> dict[str, DataFrame]:
        """All six logical tables with their ids."""
        return {
            "customers": self.customers,
            "products": self.products,
            "shop_orders": self.labeled_orders if with_label else self.shop_orders,
            "order_items": self.order_items,
            "shipments": self.shipments,
            "order_predictions": self.order_predictions,
        }
