import datetime as dt

import seed
from pyspark.sql import functions as F

from packhouse.operators.quality import contract_audit, table_profile
from packhouse.operators.runlog import run_log_summary
from packhouse.schemas import RUN_LOGS


def violations(tables):
    return {(r.table_name, r.constraint_name): r.violations for r in contract_audit(tables).collect() if r.violations}


def test_seed_breaks_nothing(spark):
    audit = contract_audit(seed.tables(spark))
    assert audit.where("violations <> 0").count() == 0
    assert audit.count() == audit.select("table_name", "constraint_name").distinct().count()


def test_broken_rows_are_counted(spark):
    day = dt.datetime(2026, 1, 1)
    tables = seed.tables(
        spark,
        customers=seed.CUSTOMERS + [(1, "x", "y", None), (1, None, "y", None), (None, "x", "y", None)],
        shop_orders=seed.ORDERS + [(4, 77, day, 1.0, 1.0), (5, 77, None, 1.0, 1.0), (6, None, day, 1.0, 1.0)],
        order_items=seed.ITEMS + [(9, 1, 1, 0, 1.0, 1.0), (10, 1, 99, -1, 1.0, 1.0), (11, 55, 1, None, 1.0, 1.0)],
        shipments=seed.SHIPMENTS + [(2, 2, 7), (3, 2, None)],
        order_predictions=[(1, 0.0, 2, 0.0, 0, day), (1, 0.0, 0, 0.0, -1, day), (80, 0.0, 0, 0.0, 1, day)])
    assert violations(tables) == {
        ("customers", "customer_id_unique"): 2, ("customers", "customer_id_not_null"): 1,
        ("customers", "full_name_not_null"): 1,
        ("shop_orders", "customer_id_in_customers"): 2, ("shop_orders", "order_datetime_not_null"): 1,
        ("shop_orders", "customer_id_not_null"): 1,
        ("order_items", "quantity_positive"): 2, ("order_items", "quantity_not_null"): 1,
        ("order_items", "product_id_in_products"): 1, ("order_items", "order_id_in_shop_orders"): 1,
        ("shipments", "late_delivery_flag"): 1, ("shipments", "late_delivery_not_null"): 1,
        ("order_predictions", "order_id_unique"): 1, ("order_predictions", "predicted_late_delivery_flag"): 1,
        ("order_predictions", "predicted_fraud_flag"): 1, ("order_predictions", "order_id_in_shop_orders"): 1,
    }


def test_missing_table_is_one_violation(spark):
    tables = seed.tables(spark)
    del tables["products"]
    assert violations(tables) == {("products", "table_present"): 1}


def test_profile(spark):
    tables = seed.tables(spark, customers=seed.CUSTOMERS + [(4, "x", "y", None)])
    rows = {(r.table_name, r.name): r for r in table_profile(tables).collect()}
    birthdate = rows["customers", "birthdate"]
    assert (birthdate.cid, birthdate.type, birthdate.notnull, birthdate.n_rows, birthdate.n_nulls) == (3, "string", 0, 4, 1)
    assert rows["shop_orders", "risk_score"].dflt_value == "50" and rows["shop_orders", "order_id"].pk == 1
    assert rows["order_predictions", "order_id"].n_rows == 0


def test_profile_shows_what_is_there(spark):
    tables = seed.tables(spark)
    orders = tables["shop_orders"]
    tables["shop_orders"] = orders.withColumn("order_total", F.col("order_total").cast("string")).withColumn("is_fraud", F.lit(1))
    tables["extra table"] = spark.createDataFrame([(1, None), (2, None)], "`a b` int, c array<string>")
    rows = {(r.table_name, r.name): r for r in table_profile(tables).collect()}
    assert rows["shop_orders", "order_total"].type == "string" and rows["shop_orders", "order_total"].notnull == 1
    assert (rows["shop_orders", "is_fraud"].cid, rows["shop_orders", "is_fraud"].dflt_value) == (5, None)
    assert [(r.type, r.n_rows, r.n_nulls, r.pk) for n, r in rows.items() if n[0] == "extra table"] == [
        ("int", 2, 0, 0), ("array<string>", 2, 2, 0)]


def test_run_logs(spark):
    long = "x" * 4001
    cases = [
        (0, "a\nRESULT orders_scored=12\nRESULT fraud_flagged_ids=3,4\n", "", (True, 12, [3, 4])),
        (0, "Orders Scored : 7", "", (True, 7, [])),
        (0, "we scored 9 orders", "", (True, 9, [])),
        (0, "scored 9 orders", "orders-scored=4", (True, 4, [])),
        (1, "", "ERROR", (False, None, [])),
        (1, "RESULT orders_scored=0\nRESULT fraud_flagged_ids=\n", "boom", (False, 0, [])),
        (None, None, None, (False, None, [])),
        (0, long + "\nORDERSSCORED=5", "", (True, 5, [])),
    ]
    logs = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], RUN_LOGS)
    got = run_log_summary(logs).orderBy("run_id").collect()
    assert [(r.ok, r.orders_scored, r.flagged_ids) for r in got] == [c[3] for c in cases]
    assert got[7].stdout_preview == "x" * 4000 + "\n… (truncated)" and got[0].stdout_preview == cases[0][1]
    assert got[4].error_message == "Python process exited with code 1" and got[0].error_message is None
