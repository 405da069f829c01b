import seed
from pyspark.sql import functions as F

from packhouse.jobs import main
from packhouse.sources.store import VersionedStore
from packhouse.streaming.intake import placed


def write(tables, folder):
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")


def test_train_then_score(spark, tmp_path, capsys):
    i = F.col("id")
    tables = seed.tables(spark)
    tables["shop_orders"] = spark.range(1, 401).select(
        i.alias("order_id"), (i % 3 + 1).alias("customer_id"),
        F.lit("2026-01-01").cast("timestamp_ntz").alias("order_datetime"), F.lit(1.0).alias("order_total"),
        (i % 100).cast("double").alias("risk_score"), (i % 100 + i % 7 > 90).cast("int").alias("is_fraud"))
    shop, model, store = (str(tmp_path / n) for n in ("shop", "model", "store"))
    write(tables, shop)
    assert main(["train", "--tables", shop, "--model", model]) == 0
    assert "roc_auc=" in capsys.readouterr().out
    assert main(["score", "--tables", shop, "--store", store, "--model", model, "--run-ts", seed.NOW,
                 "--flagged", f"{store}/flagged"]) == 0
    out = capsys.readouterr().out
    flagged = spark.read.parquet(f"{store}/flagged").count()
    assert "RESULT orders_scored=399" in out and f"RESULT fraud_flagged_orders={flagged}" in out and flagged > 0
    assert VersionedStore(spark, store).read().count() == 399


def test_scoring_without_a_model_and_with_a_broken_table(spark, tmp_path, capsys):
    tables = seed.tables(spark)
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    write(tables, good)
    assert main(["score", "--tables", good, "--store", str(tmp_path / "s1")]) == 0
    assert "RESULT orders_scored=2" in capsys.readouterr().out
    write({**tables, "shop_orders": tables["shop_orders"].withColumn("order_total", F.lit("text"))}, bad)
    assert main(["score", "--tables", bad, "--store", str(tmp_path / "s2")]) == 1
    captured = capsys.readouterr()
    assert "RESULT orders_scored=0" in captured.out and "ERROR" in captured.err


def test_intake_job(spark, tmp_path):
    shop, inbox, out = (str(tmp_path / n) for n in ("shop", "in", "out"))
    write(seed.tables(spark), shop)
    seed.requests(spark, ("1", '[{"product_id":1,"quantity":2}]')).write.parquet(inbox)
    args = ["intake", "--tables", shop, "--requests", inbox, "--out", out, "--checkpoint", str(tmp_path / "cp")]
    assert main(args) == 0 and main(args) == 0
    assert seed.rows(placed(spark, out, "orders"), "order_id", "order_total") == [(4, 9.0)]
