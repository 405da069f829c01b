import datetime as dt

import pytest
import seed
from pyspark.sql import functions as F

from packhouse.functions.scalars import customer_age, hash_score, hash_score_at, leading_int, time_text
from packhouse.operators import features, quantiles
from packhouse.schemas import FRAUD_FEATURES


def js_hash(order_id, customer_id, total, text):
    h = order_id * 374761 + customer_id * 66041 + int(total * 100 + 0.5) * 104729
    for i, c in enumerate(text):
        h = (h + ord(c) * (i + 1)) % 2**32
    return min(0.99, max(0.01, h % 10000 / 10000))


def test_hash_score(spark):
    orders = seed.table(spark, "shop_orders", seed.ORDERS)
    scored = orders.select(hash_score_at(
        F.col("order_id"), F.col("customer_id"), F.col("order_total"), F.col("order_datetime")))
    assert seed.rows(scored) == [(0.6234,), (0.7196,), (0.7071,)]


def test_hash_score_texts(spark):
    data = [(i * 7919, i % 97, i * 13.37, text) for i, text in enumerate(
        ["2026-01-26 00:00:00", "", "2026-01-26 00:00:00.123456+00", "x" * 60, "1999-12-31 23:59:59"] * 20)]
    df = spark.createDataFrame(data + [(5, 6, 7.0, None)], "o long, c long, t double, s string")
    got = [r[0] for r in seed.rows(df.select(hash_score(*[F.col(c) for c in "octs"])))]
    assert got == [js_hash(*row) for row in data] + [js_hash(5, 6, 7.0, "")]


def test_hash_score_at_equals_the_text_form(spark):
    moments = [(i, dt.datetime(1900, 1, 1) + dt.timedelta(days=i * 37, seconds=i * 977, microseconds=i)) for i in range(500)]
    df = spark.createDataFrame(moments + [(999, None)], "i long, m timestamp_ntz")
    args = (F.col("i"), F.col("i"), F.lit(1.5))
    wrong = df.where(hash_score_at(*args, F.col("m")) != hash_score(*args, time_text(F.col("m"))))
    assert wrong.count() == 0


def test_leading_int(spark):
    cases = {"2abc": 2, " 7": 7, " ﻿8": 8, "-3": -3, "+4x": 4, "3.7": 3, "": None, "abc": None, "0x10": 0,
             "9" * 30: 9223372036854775807, "-" + "9" * 30: -9223372036854775807, "9" * 310: None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert [r[0] for r in seed.rows(df.select(leading_int(F.col("s"))))] == list(cases.values())


def test_customer_age_floors(spark):
    cases = [("2026-01-26 00:00:00", "1990-03-10", 35.0), ("2020-01-01 10:00:00", "2020-01-01 11:00:00", -1.0),
             ("2020-01-01 00:00:00", "2020-06-01", -1.0), ("2020-12-30 23:59:59", "2020-01-01", 0.0),
             ("2020-12-31 00:00:00", "2020-01-01", 1.0), ("2020-01-01 00:00:00", "unknown", None),
             ("2020-01-01 00:00:00", None, None)]
    df = spark.createDataFrame([c[:2] for c in cases], "o string, b string")
    assert [r[0] for r in seed.rows(df.select(customer_age(F.col("o"), F.col("b"))))] == [c[2] for c in cases]


def test_serving_features(spark):
    rows = seed.rows(features.fraud_features_serving(seed.tables(spark)).orderBy("order_id"))
    assert rows == [(1, 38.0, 2.0, 9.0, 2.1, 35.0, 2.0), (3, 44.0, 1.0, 8.25, 3.0, 40.0, 1.0)]


def gaps(spark):
    """Order 4 has no lines, order 5 an unknown customer, order 6 an unknown product beside a known one."""
    day = dt.datetime(2026, 1, 30)
    t = seed.tables(
        spark,
        shop_orders=seed.ORDERS + [(4, 3, day, 7.0, 1.0), (5, 77, day, 5.0, 2.0), (6, 2, day, 6.0, 3.0)],
        order_items=seed.ITEMS + [(4, 6, 1, 2, 4.5, 9.0), (5, 6, 99, 3, 1.0, 3.0), (6, 5, 2, 1, 12.0, 12.0)])
    t["shop_orders"] = t["shop_orders"].withColumn("is_fraud", F.lit(0))
    return t


def test_the_two_feature_sets_differ_where_they_should(spark):
    t = gaps(spark)
    serving = {r[0]: r[1:] for r in seed.rows(features.fraud_features_serving(t))}
    training = {r[0]: r[1:-1] for r in seed.rows(features.fraud_features_training(t))}
    assert sorted(serving) == [1, 3, 4, 6] and sorted(training) == [1, 2, 3, 4, 5, 6]
    assert serving[4][1:4] == (0.0, 7.0, 7.0) and training[4][1:4] == (None, None, None)
    assert serving[6][1:4] == (2.0, 9.0, 2.1) and training[6][1:4] == (5.0, 12.0, 2.1)
    assert training[5][4:] == (None, 1.0)


def test_strict_dates_stop_on_bad_text(spark):
    t = gaps(spark)
    t["customers"] = seed.table(spark, "customers", [(1, "a", "b", "unknown")])
    assert features.fraud_features_training(t).count() == 6
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        features.fraud_features_training(t, strict_dates=True).collect()


def test_training_sum_of_no_values_is_zero(spark):
    lines = seed.table(spark, "order_items", [(1, 1, 99, None, None, None)])
    rows = seed.rows(features.item_aggregates_training(lines, seed.table(spark, "products", seed.PRODUCTS)))
    assert rows == [(1, 0, None, 0.0, None)]


def test_late_features(spark):
    row = seed.rows(features.late_delivery_features(seed.tables(spark)))
    assert row == [(1, 2, 29.99, 1, 0, 3, 0)]


def test_label_distribution(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,), (None,)], "y int")
    assert seed.rows(features.label_distribution(df, "y")) == [(0, 0.75), (1, 0.25)]


def test_feature_summary(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "x double").withColumn("z", F.lit(None).cast("double"))
    x, z = features.feature_summary(df, ["x", "z"]).orderBy("feature").collect()
    assert tuple(x) == ("x", 3, pytest.approx(7 / 3), pytest.approx(1.5275252316519468), 1.0, 1.5, 2.0, 3.0, 4.0)
    assert tuple(z) == ("z", 0) + (None,) * 7


COLUMNS = {
    "spread": [((i * 7919) % 100003) / 7 for i in range(5001)],
    "heavy": [42.0 if i % 3 else float(i) for i in range(5001)],
    "skewed": [float(2 ** (i % 50)) + i / 1e4 for i in range(5001)],
    "constant": [3.25] * 5001,
    "signed": [(-1) ** i * i / 3 for i in range(5001)],
    "close": [1.0 + i * 2.0**-52 for i in range(5001)],
    "tiny": [i * 5e-324 * (-1) ** i for i in range(5001)],
    "huge": [0.8e308 * ((i - 2500) / 2500) for i in range(5001)],
}


def test_quantiles_are_exact_in_at_most_six_passes(spark, monkeypatch):
    import numpy as np
    passes = []
    real = quantiles._narrow
    monkeypatch.setattr(quantiles, "_narrow", lambda *a: (passes.append(a[2:]), real(*a)))
    df = spark.createDataFrame(list(zip(*COLUMNS.values())), ", ".join(f"{c} double" for c in COLUMNS))
    probabilities = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = quantiles.exact_quantiles(df, list(COLUMNS), probabilities)
    for name, values in COLUMNS.items():
        assert got[name] == pytest.approx(list(np.quantile(values, probabilities)), rel=1e-12), name
    assert passes == [(52, 12), (40, 12), (28, 12), (16, 12), (4, 12), (0, 4)]
    passes.clear()
    assert quantiles.exact_quantiles(df.select("spread"), ["spread"], [0.5])["spread"] == pytest.approx([np.median(COLUMNS["spread"])])
    assert len(passes) <= 3
    passes.clear()
    assert quantiles.exact_quantiles(df.select("constant"), ["constant"], [0.5]) == {"constant": [3.25]} and len(passes) == 1
    assert quantiles.exact_quantiles(df.select("heavy"), ["heavy"], [0.5]) == {"heavy": [42.0]} and len(passes) <= 3


def test_ordered_bits_are_those_of_memory(spark):
    import struct
    values = [0.0, -0.0, 1.0, -1.0, 2.0, 3.0, 0.1, 1e300, -1e-300, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308,
              1.7976931348623157e308, float("inf"), float("-inf"), *[2.0**e for e in range(-1070, 1020, 37)],
              *[2.0**e * (1 - 2.0**-53) for e in range(-1000, 1020, 41)], *[2.0**e * (1 + 2.0**-52) for e in range(-1000, 1020, 41)]]
    rows = quantiles.with_ordered_bits(spark.createDataFrame([(v,) for v in values], "x double"), {"x": "b"})
    for r in rows.collect():
        (bits,) = struct.unpack(">q", struct.pack(">d", abs(r.x)))
        assert r.b == (-1 - bits if r.x < 0 else bits), r


def test_quantiles_with_infinities_and_missing(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(-inf,), (1.0,), (inf,), (nan,), (None,), (2.0,), (inf,)], "x double")
    assert quantiles.exact_quantiles(df, ["x"], [0.0, 0.25, 0.5, 1.0]) == {"x": [-inf, 1.0, 2.0, inf]}
    assert quantiles.exact_quantiles(df.limit(0), ["x"], [0.5]) == {"x": [None]}


def test_feature_columns_are_the_six(spark):
    assert features.fraud_features_serving(seed.tables(spark)).columns == ["order_id", *FRAUD_FEATURES]
