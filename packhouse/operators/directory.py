"""Customers and products: lists, search and id resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packhouse.functions.scalars import leading_int, number_or_zero, web_trim
from packhouse.operators.joins import lookup_join
from packhouse.sources.shared import materialize

def customers_list(customers: DataFrame) -> DataFrame:
    return customers.select("customer_id", "full_name", "email").orderBy(F.lower("full_name"), "customer_id")


def products_list(products: DataFrame) -> DataFrame:
    return products.select("product_id", "product_name", number_or_zero("price")).orderBy(F.lower("product_name"), "product_id")


def _searchable(customers: DataFrame) -> DataFrame:
    return customers.select(
        "customer_id", "full_name", "email",
        F.lower(F.concat_ws(" ", F.coalesce("full_name", F.lit("null")), F.coalesce("email", F.lit("null")),
                            F.col("customer_id").cast("string"))).alias("_hay"),
    )


def customer_search(customers: DataFrame, needles: Sequence[str] | DataFrame) -> DataFrame:
    """Customers whose "name email id" contains each needle literally; blank finds everyone.

    Typed needles (a list) are checked in place: one scan, no join, no shuffle. A table of
    needles (column `needle`) is matched through hashes, see `_search_table`.
    """
    hay = _searchable(customers)
    if isinstance(needles, DataFrame):
        return _search_table(hay, needles)
    # Foldable: trimmed and lowered once, not per row.
    typed = F.array(*[
        F.struct(F.lit(n).alias("needle"), F.lower(web_trim(F.lit(n))).alias("text")) for n in dict.fromkeys(needles)])
    # The outer transform binds the text of a customer once for all needles.
    hits = F.transform(F.array("_hay"), lambda h: F.filter(typed, lambda n: F.contains(h, n["text"])))
    return hay.select(F.explode(hits[0]).alias("hit"), "customer_id", "full_name", "email").select(
        "hit.needle", "customer_id", "full_name", "email")


def _hashed(text: Column) -> Column:
    return F.xxhash64(text)


def _search_table(hay: DataFrame, needles: DataFrame) -> DataFrame:
    """Containment as an equi-join on hashes of whole needles, then the full check.

    A needle of n characters can only lie in a text that has a piece of n characters with its hash. So each text gives
    the distinct hashes of its pieces at the lengths that needles have, one row of two numbers and an id each; names, mails and
    texts are fetched by id for the hits alone. A piece that everyone has costs rows only if it is a needle, and then these
    are its answers; their join is one of plain shuffles, which adaptive execution splits. A text of m characters gives
    at most m rows a length.
    """
    asked = materialize(needles.select("needle", F.lower(web_trim(F.col("needle"))).alias("_text")).where(
        "_text is not null").distinct().select(
        "needle", "_text", F.length("_text").alias("_length"), _hashed(F.col("_text")).alias("_hash")), "needles")
    # No longer list than the longest needle has characters.
    lengths = F.broadcast(asked.select("_length").distinct())
    sized = hay.select("customer_id", "_hay").join(lengths, F.length("_hay") >= F.col("_length"))
    places = F.sequence(F.lit(1), F.when(F.col("_length") == 0, F.lit(1)).otherwise(F.length("_hay") - F.col("_length") + 1))
    hashes = F.array_distinct(F.transform(places, lambda at: _hashed(F.substr(F.col("_hay"), at, F.col("_length")))))
    pieces = sized.select("customer_id", "_length", F.explode(hashes).alias("_hash"))
    hits = pieces.join(asked, ["_length", "_hash"]).select("customer_id", "needle", "_text")
    return hits.join(hay, "customer_id").where(F.contains("_hay", F.col("_text"))).select(
        "needle", "customer_id", "full_name", "email")


def customer_resolve(requests: DataFrame, customers: DataFrame, mode: str, ref: str = "customer_ref") -> DataFrame:
    """Classify typed customer ids.

    Mode "form": `invalid` (no positive number), `unknown` (no such customer), `ok`.
    Mode "session": `none`, `invalid_cookie`, `ok`.
    """
    bad, absent = {"form": ("invalid", "unknown"), "session": ("none", "invalid_cookie")}[mode]
    parsed = leading_int(F.col(ref))
    known = customers.select("customer_id", F.lit(True).alias("_known"))
    looked_up = lookup_join(
        requests.withColumn("customer_id", F.when(parsed > 0, parsed)), "customer_id",
        [(known, "left")])
    status = (
        F.when(F.col("customer_id").isNull(), bad).when(F.col("_known").isNull(), absent).otherwise("ok"))
    return looked_up.select(*requests.columns, "customer_id", status.alias("status"))


def product_price(product_ids: DataFrame, products: DataFrame) -> DataFrame:
    """Current price for each asked id; unknown ids give no row."""
    return lookup_join(
        product_ids.select("product_id").distinct(), "product_id",
        [(products.select("product_id", number_or_zero("price")), "inner")])
