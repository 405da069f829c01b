"""Every registered query against its SQL in DuckDB."""

import compare
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(DATA)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    assert compare.differences(QUERIES[name](spark, DATA), con, ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


LOOKUPS = [
    "customer_search_table", "customer_resolve", "product_price", "order_ownership", "order_header",
    "order_line_items", "warehouse_priority_queue", "fraud_flagged_open_orders", "item_aggregates_serving",
    "item_aggregates_training", "fraud_features_serving", "fraud_features_training", "late_delivery_features",
    "order_intake", "place_orders", "cart_preview",
]


@pytest.mark.parametrize("name", LOOKUPS)
def test_lookups_match_without_broadcasting_too(spark, con, name):
    """As on large tables: nothing is small enough to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert compare.differences(QUERIES[name](spark, DATA), con, ORACLE[name]) == ""
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_entry(spark):
    assert entry.entry(spark).count() == 50
