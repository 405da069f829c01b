"""From order requests to orders: parsing, validation, pricing and id assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packhouse.functions.scalars import WEB_SPACE, leading_int, number_or_zero
from packhouse.operators.directory import customer_resolve
from packhouse.operators.joins import lookup_join
from packhouse.operators.numbering import running_totals
from packhouse.schemas import DEFAULT_RISK_SCORE


def _json_array(raw: Column) -> Column:
    """The elements of a text that is exactly one JSON array, else null.

    Spark's parser ignores what follows the first value. Only a text that ends with its value
    parses both as an object member and as an array element.
    """
    member = F.try_parse_json(F.concat(F.lit('{"lines":'), raw, F.lit("}")))
    element = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    return F.when(element.isNotNull(), F.try_variant_get(member, "$.lines", "array<variant>"))


def _number_text(number: Column) -> Column:
    """Digits of the whole part. Very large and very small numbers are written with an
    exponent, of which a lenient reader sees the first digit only."""
    size = F.abs(number)
    exponent = (size >= 1e21) | ((size > 0) & (size < 1e-6))
    return F.when(exponent, number.cast("string")).otherwise(F.floor(number).cast("string"))


def _field_text(item: Column, name: str) -> Column:
    """A field as the text its leading integer is read from; an array counts as its first element."""
    path = f"$.{name}"
    field = F.try_variant_get(item, path, "variant")
    text = F.try_variant_get(item, path, "string")
    kind = F.substring(F.schema_of_variant(field), 1, 3)
    return (
        F.when(kind.isin("DOU", "DEC", "FLO"), _number_text(F.try_variant_get(item, path, "double")))
        .when(kind == "ARR", F.regexp_extract(text, rf'^(?:\[[{WEB_SPACE}]*)+"?(.*)$', 1))
        .otherwise(text))


def _with_lines(requests: DataFrame) -> DataFrame:
    """Append `_lines`: array<struct<product_id, quantity>>, null if the payload is no JSON array."""
    texts = F.transform(
        _json_array(F.col("order_lines")),
        lambda item: F.struct(_field_text(item, "product_id").alias("product_id"),
                              _field_text(item, "quantity").alias("quantity")))
    return requests.withColumn("_lines", F.transform(
        texts, lambda line: F.struct(leading_int(line["product_id"]).alias("product_id"),
                                     leading_int(line["quantity"]).alias("quantity"))))


def _usable(line: Column) -> Column:
    return F.coalesce((line["product_id"] > 0) & (line["quantity"] > 0), F.lit(False))


def _lines_ok() -> Column:
    return F.coalesce((F.size("_lines") > 0) & F.forall("_lines", _usable), F.lit(False))


def order_lines_parse(requests: DataFrame) -> DataFrame:
    """One row per payload line, from 1; one row without a line for a payload that has none.

    `lines_ok` is true only if the payload is an array with at least one line and every line
    has a positive product id and quantity.
    """
    parsed = _with_lines(requests).select("request_id", "_lines", _lines_ok().alias("lines_ok"))
    return parsed.select(
        "request_id", "lines_ok", F.posexplode_outer("_lines").alias("_at", "_line")
    ).select("request_id", (F.col("_at") + 1).alias("line_no"), "_line.product_id", "_line.quantity", "lines_ok")


def one_per_request(requests: DataFrame) -> DataFrame:
    """The earliest row of each request id, reduced before any shuffle; rows without an id are requests of their own."""
    kept = F.struct(F.col("requested_at").isNull(), "requested_at", "customer_ref", "order_lines")
    first = requests.where("request_id is not null").groupBy("request_id").agg(F.min(kept).alias("_first"))
    columns = ["request_id", "requested_at", "customer_ref", "order_lines"]
    return first.select("request_id", "_first.requested_at", "_first.customer_ref", "_first.order_lines").unionByName(
        requests.where("request_id is null").select(*columns))


def order_intake(requests: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """Decide each request once: `no_customer`, `lines`, `product` or `accepted`, in this order.

    Rows that repeat a request id are one request, of which the earliest counts. Lines carry the
    current catalog price; one that is null or no number is 0. Requests with bad lines are not exploded,
    and one grouping brings each request's lines back together, so no request is joined to itself.
    """
    keys = ["request_id", "requested_at", "customer_id", "_customer", "_ok"]
    checked = customer_resolve(one_per_request(requests), customers, "session").withColumnRenamed("status", "_customer")
    checked = _with_lines(checked).withColumn("_ok", _lines_ok())
    lines = checked.select(
        *keys, F.posexplode_outer(F.when(F.col("_ok"), F.col("_lines"))).alias("_at", "_line")
    ).select(*keys, (F.col("_at") + 1).alias("line_no"), "_line.product_id", "_line.quantity")
    priced = lookup_join(
        lines, "product_id",
        [(products.select("product_id", number_or_zero("price").alias("unit_price"), F.lit(True).alias("_found")), "left")])
    grouped = priced.groupBy(*keys).agg(
        F.bool_and(F.col("_found").isNotNull()).alias("_known"),
        F.array_sort(F.collect_list(F.struct("line_no", "product_id", "quantity", "unit_price"))).alias("lines"))
    status = (
        F.when(F.col("_customer") != "ok", "no_customer").when(~F.col("_ok"), "lines")
        .when(~F.col("_known"), "product").otherwise("accepted"))
    decided = grouped.withColumn("status", status)
    accepted = F.col("status") == "accepted"
    total = F.aggregate("lines", F.lit(0.0), lambda sum_, line: sum_ + line["quantity"] * line["unit_price"])
    return decided.select(
        "request_id", "requested_at", F.when(F.col("_customer") == "ok", F.col("customer_id")).alias("customer_id"),
        "status", F.when(accepted, total).alias("order_total"), F.when(accepted, F.col("lines")).alias("lines"))


def last_id(table: DataFrame, key: str) -> Column:
    """The largest id so far, 0 for an empty table, as a scalar subquery."""
    return table.agg(F.coalesce(F.max(key), F.lit(0).cast("bigint"))).scalar()


def place_orders(decided: DataFrame, last_order: Column, last_item: Column) -> tuple[DataFrame, DataFrame]:
    """Orders and lines for the accepted requests, numbered on from the last ids.

    Numbers follow (requested_at, request_id); lines keep their payload order. The order time
    is the request's and the risk score the column default.
    """
    accepted = decided.where("status = 'accepted'").select(
        "request_id", "requested_at", "customer_id", "order_total", "lines")
    placed = running_totals(
        accepted, ["requested_at", "request_id"], {"_orders": F.lit(1), "_items": F.size("lines")})
    placed = placed.withColumn("order_id", last_order + F.col("_orders"))
    orders = placed.select(
        "order_id", "customer_id", F.col("requested_at").alias("order_datetime"), "order_total",
        F.lit(DEFAULT_RISK_SCORE).alias("risk_score"), "request_id")
    items = placed.select(
        "order_id", (F.col("_items") - F.size("lines")).alias("_before"), F.explode("lines").alias("l")
    ).select(
        (last_item + F.col("_before") + F.col("l.line_no")).alias("order_item_id"), "order_id",
        "l.product_id", "l.quantity", "l.unit_price",
        (F.col("l.quantity") * F.col("l.unit_price")).alias("line_total"))
    return orders, items


def cart_preview(requests: DataFrame, products: DataFrame) -> DataFrame:
    """Running total of the usable lines, and whether the cart may be submitted.

    Unlike intake, a bad or unknown line is left out instead of failing the request; a cart
    may be submitted once one line has a positive product id and quantity.
    """
    carts = _with_lines(requests).select(
        "request_id", F.coalesce(F.size("_lines"), F.lit(0)).alias("n_lines"),
        F.coalesce(F.exists("_lines", _usable), F.lit(False)).alias("can_submit"), "_lines")
    lines = carts.select(
        "request_id", "n_lines", "can_submit", F.posexplode_outer("_lines").alias("_at", "_line")
    ).select("request_id", "n_lines", "can_submit", "_at", "_line.product_id", "_line.quantity")
    priced = lookup_join(lines, "product_id", [(products.select("product_id", number_or_zero("price")), "left")])
    amount = F.when(F.col("quantity") > 0, F.col("price") * F.col("quantity"))
    return priced.groupBy("request_id", "n_lines", "can_submit").agg(
        F.coalesce(F.sum(amount), F.lit(0.0)).alias("preview_total")
    ).select("request_id", "n_lines", "preview_total", "can_submit")
