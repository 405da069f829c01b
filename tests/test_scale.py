"""Skewed inputs give the same results, and plans have the shape they were written for."""

import io
import contextlib

import pytest
import seed
from pyspark.sql import functions as F

from packhouse.operators import directory, features, joins, orders, queue
from packhouse.operators.joins import lookup_join
from packhouse.operators.numbering import number_rows, running_totals
from packhouse.operators.scoring import upsert_predictions
from packhouse.sources.star import StarTables

DATA = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows has key 7, a tenth none."""
    i = F.col("id")
    key = F.when(i % 3 == 0, 7).when(i % 10 == 1, F.lit(None)).otherwise(i % 101)
    return spark.range(6000).select(i, key.cast("long").alias("k")).cache()


@pytest.fixture
def fine_splits(spark, no_broadcast):
    """Small tables behave as large ones: partitions of some KB count as large, and nothing is broadcast or merged."""
    settings = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.files.maxPartitionBytes": "8k",
                "spark.sql.files.openCostInBytes": "1k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]


def hot_tables(spark, tmp_path, rows=6000):
    """Half the orders are of customer 1; everything is read from files of several parts."""
    i = F.col("id")
    written = {
        "shop_orders": spark.range(1, rows + 1, 1, 8).select(
            i.alias("order_id"), F.when(i % 2 == 0, 1).otherwise(i % 500 + 1).cast("long").alias("customer_id"),
            F.lit("2026-01-01 10:00:00").cast("timestamp_ntz").alias("order_datetime"), (i * 1.5).alias("order_total"),
            (i % 97 * 1.0).alias("risk_score"), (i % 7 == 0).cast("int").alias("is_fraud")),
        "order_items": spark.range(1, rows + 1, 1, 8).select(
            i.alias("order_item_id"), i.alias("order_id"), (i % 9 + 1).alias("product_id"), F.lit(2).alias("quantity"),
            F.lit(1.5).alias("unit_price"), F.lit(3.0).alias("line_total")),
        "customers": spark.range(1, 600, 1, 8).select(
            i.alias("customer_id"), F.concat(F.lit("Person "), i).alias("full_name"), F.concat(i, F.lit("@example.edu")).alias("email"),
            F.lit("1980-05-05").alias("birthdate")),
        "products": spark.range(1, 10).select(i.alias("product_id"), (i * 1.0).alias("cost"), (i * 2.0).alias("price"),
                                              F.lit("p").alias("product_name")),
        "shipments": spark.range(0).select(i.alias("order_id"), i.alias("shipment_id"), i.cast("int").alias("late_delivery")),
    }
    for name, df in written.items():
        df.write.parquet(str(tmp_path / name))
    return {name: spark.read.parquet(str(tmp_path / name)) for name in written}


@pytest.mark.parametrize("build", [features.fraud_features_serving, features.fraud_features_training])
def test_a_customer_with_half_of_all_orders_is_split(spark, fine_splits, tmp_path, build):
    found = build(hot_tables(spark, tmp_path))
    assert "SortMergeJoin(skew=true)" in final_plan(found)
    assert found.count() == 6000 and found.where("customer_order_count = 3000").count() == 3000


def test_a_needle_that_everyone_has_is_split_and_only_ids_travel(spark, fine_splits, tmp_path):
    people = hot_tables(spark, tmp_path)["customers"]
    needles = spark.createDataFrame(
        [("person",), (" PERSON ",), ("17@example",), ("",), ("n 123 1",), ("nobody at all",), ("9",), (None,)], "needle string")
    found = directory.customer_search(people, needles)
    blank = directory.customer_search(people, needles.where("trim(needle) = ''"))
    assert "skew=true" in final_plan(blank) and blank.count() == 599
    hay = {i: f"person {i} {i}@example.edu {i}" for i in range(1, 600)}
    want = {(n, i) for (n,) in [("person",), (" PERSON ",), ("17@example",), ("",), ("n 123 1",), ("9",)] for i, h in hay.items()
            if n.strip().lower() in h}
    assert sorted(seed.rows(found, "needle", "customer_id")) == sorted(want)
    # Below the join of hashes no exchange carries a text of a customer.
    moved = [block for block in plan(found).split("\n\n") if "Exchange" in block.split("\n")[0] and "_hash" in block.split("Arguments")[0]]
    assert len(moved) == 2 and not any(c in block for block in moved for c in ("full_name", "email", "_hay"))


def test_lookups_count_nothing_first(spark, no_broadcast):
    star = StarTables(spark, DATA)
    for df in (orders.order_ownership(star.order_claims, star.shop_orders),
               lookup_join(star.shop_orders, "customer_id", [(star.customers, "inner")])):
        assert "HashAggregate" not in plan(df) and plan(df).count("Exchange hashpartitioning") <= 4


def test_narrow_lookups_are_broadcast_by_their_counted_rows(spark, no_broadcast, monkeypatch):
    star = StarTables(spark, DATA)
    moved = plan(features.item_aggregates_serving(star.items, star.products))
    assert "BroadcastHashJoin" in moved and "hashpartitioning(product_id" not in moved
    monkeypatch.setattr(joins, "NARROW_BYTES", 10)
    assert "BroadcastHashJoin" not in plan(features.item_aggregates_serving(star.items, star.products))


def test_small_lookup_moves_no_fact_row(spark, skewed):
    names = spark.range(90).select(F.col("id").alias("k"), F.lit("n").alias("name"))
    text = plan(lookup_join(skewed, "k", [(names, "inner")]))
    assert "BroadcastHashJoin" in text


def test_search_with_a_piece_everyone_has(spark, no_broadcast):
    people = spark.range(300).select(
        F.col("id").alias("customer_id"), F.lit("Common").alias("full_name"),
        F.concat(F.lit("c"), "id", F.lit("@example.edu")).alias("email"), F.lit(None).cast("string").alias("birthdate"))
    needles = spark.createDataFrame([("example",), ("common c7@",), ("",)], "needle string")
    found = directory.customer_search(people, needles).groupBy("needle").count()
    assert dict(seed.rows(found)) == {"example": 300, "common c7@": 1, "": 300}


def test_numbers_are_dense_and_ordered_with_hot_ties(spark, skewed):
    numbered = number_rows(skewed, ["k", "id"], "n").collect()
    ordered = sorted(numbered, key=lambda r: r.n)
    assert [r.n for r in ordered] == list(range(1, 6001))
    keys = [(-1 if r.k is None else r.k, r.id) for r in ordered]
    assert keys == sorted(keys)


def test_running_totals(spark):
    df = spark.range(1000).select((F.lit(999) - F.col("id")).alias("id"), (F.col("id") % 5).alias("w"))
    got = sorted(seed.rows(running_totals(df, ["id"], {"rows": F.lit(1), "sum": F.col("w")}), "id", "rows", "sum"))
    total = 0
    for i, (identity, rows, running) in enumerate(got):
        total += (999 - identity) % 5
        assert (identity, rows, running) == (i, i + 1, total)


def test_upsert_with_one_order_in_a_third_of_the_batch(spark):
    i = F.col("id")
    new = spark.range(3000).select(
        F.when(i % 3 == 0, 7).otherwise(i).alias("order_id"), F.lit(0.0).alias("late_delivery_probability"),
        F.lit(0).alias("predicted_late_delivery"), (i / 3000).alias("fraud_probability"),
        F.lit(0).alias("predicted_fraud"), i.alias("seq"))
    result = upsert_predictions(seed.table(spark, "order_predictions", []), new, seed.NOW, order_by="seq")
    assert result.where("order_id = 7").first().fraud_probability == 2997 / 3000
    assert result.count() == new.select("order_id").distinct().count()


def test_top_orders_are_cut_before_the_shuffle(spark):
    star = StarTables(spark, DATA)
    text = plan(orders._latest(star.shop_orders, 5))
    assert "WindowGroupLimit" in text.split("Exchange")[0] and "WindowGroupLimit" in text.split("Exchange")[1]


def test_queue_plan(spark):
    star = StarTables(spark, DATA)
    text = plan(queue.warehouse_priority_queue(
        star.shop_orders, star.customers, star.shipped, star.order_predictions))
    assert "TakeOrderedAndProject" in text and "LeftAnti" in text
    assert "EqualTo(l_linestatus,F)" in text
    assert "struct<l_orderkey:bigint,l_linestatus:string>" in text
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
        assert unwanted not in text


def test_one_customer_reaches_the_scan(spark):
    star = StarTables(spark, DATA)
    text = plan(orders.customer_recent_orders(star.shop_orders, star.items, star.shipped, customer_id=5))
    assert "LeftSemi" in text and "o_custkey" in text


def test_bucketed_tables_join_by_order_without_a_shuffle(spark, no_broadcast, tmp_path):
    from packhouse.sources.layout import load_bucketed, save_bucketed
    spark.sql(f"create database packed location '{tmp_path}/packed'")
    try:
        save_bucketed(seed.tables(spark), "packed", 4)
        t = load_bucketed(spark, "packed")
        counted = orders.order_counts(t["shop_orders"], t["order_items"], t["shipments"])
        waiting = orders.open_orders(t["shop_orders"], t["shipments"])
        assert "Exchange" not in plan(counted) and "Exchange" not in plan(waiting)
        assert sorted(seed.rows(waiting, "order_id")) == [(1,), (3,)]
        assert sorted(seed.rows(counted, "order_id", "item_count", "shipment_count")) == [
            (1, 1, 0), (2, 1, 1), (3, 1, 0)]
    finally:
        spark.sql("drop database packed cascade")
