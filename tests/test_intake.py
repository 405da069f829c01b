import datetime as dt

import pytest
import seed
from pyspark.sql import functions as F

from packhouse.operators import intake
from packhouse.streaming import applied
from packhouse.streaming.applied import IntakeState
from packhouse.streaming.intake import apply_batch, intake_stream, placed

# payload, status, accepted total, quantities, preview total, submittable
PAYLOADS = [
    ('[{"product_id":1,"quantity":2}]', "accepted", 9.0, [2], 9.0, True),
    ('[{"product_id":"1","quantity":"2abc"}]', "accepted", 9.0, [2], 9.0, True),
    ('[{"product_id":1,"quantity":3.7}]', "accepted", 13.5, [3], 13.5, True),
    ('[{"product_id":1,"quantity":1},{"product_id":1,"quantity":1}]', "accepted", 9.0, [1, 1], 9.0, True),
    ('[{"product_id":1,"quantity":1,"unit_price":0}]', "accepted", 4.5, [1], 4.5, True),
    ('[{"product_id":1,"quantity":1},{"product_id":2,"quantity":0}]', "lines", None, None, 4.5, True),
    ('[{"product_id":1,"quantity":1},5]', "lines", None, None, 4.5, True),
    ('[{"product_id":99,"quantity":1}]', "product", None, None, 0.0, True),
    ("[]", "lines", None, None, 0.0, False),
    ("{}", "lines", None, None, 0.0, False),
    ("nope", "lines", None, None, 0.0, False),
    (None, "lines", None, None, 0.0, False),
    # Whatever follows the array makes the text invalid.
    ('[{"product_id":1,"quantity":1}] x', "lines", None, None, 0.0, False),
    ('[{"product_id":1,"quantity":1}]}', "lines", None, None, 0.0, False),
    ('[{"product_id":1,"quantity":1}]]', "lines", None, None, 0.0, False),
    ('[{"product_id":1,"quantity":1}],"a":1', "lines", None, None, 0.0, False),
    (' [{"product_id":1,"quantity":1}]\n', "accepted", 4.5, [1], 4.5, True),
    # Numbers are read through their shortest text.
    ('[{"product_id":1e0,"quantity":1e1}]', "accepted", 45.0, [10], 45.0, True),
    ('[{"product_id":1,"quantity":12345678.9}]', "accepted", 4.5 * 12345678, [12345678], 4.5 * 12345678, True),
    ('[{"product_id":1,"quantity":1e-7}]', "accepted", 4.5, [1], 4.5, True),
    ('[{"product_id":1,"quantity":0.5}]', "lines", None, None, 0.0, False),
    ('[{"product_id":[1],"quantity":["2",9]}]', "accepted", 9.0, [2], 9.0, True),
    ('[{"product_id":true,"quantity":1}]', "lines", None, None, 0.0, False),
    ('[{"product_id":null,"quantity":1}]', "lines", None, None, 0.0, False),
    ('[null]', "lines", None, None, 0.0, False),
    ('[{"product_id":1,"quantity":1},{"product_id":99,"quantity":1}]', "product", None, None, 4.5, True),
    ('[{"product_id":123456789012345678901,"quantity":1}]', "product", None, None, 0.0, True),
    ('[{"product_id":1,"quantity":3000000000}]', "accepted", 4.5 * 3000000000, [3000000000], 4.5 * 3000000000, True),
    # A repeated key keeps its last value.
    ('[{"product_id":99,"product_id":1,"quantity":1}]', "accepted", 4.5, [1], 4.5, True),
]


@pytest.fixture(scope="module")
def asked(spark):
    return seed.requests(spark, *[("1", p[0]) for p in PAYLOADS])


def test_intake_statuses_and_totals(spark, asked):
    t = seed.tables(spark)
    decided = intake.order_intake(asked, t["customers"], t["products"]).orderBy("request_id").collect()
    for row, (payload, status, total, quantities, _, _) in zip(decided, PAYLOADS, strict=True):
        got = (row.status, row.order_total, row.lines and [line.quantity for line in row.lines])
        assert got == (status, total if total is None else pytest.approx(total), quantities), payload


def test_cart_preview(spark, asked):
    preview = intake.cart_preview(asked, seed.table(spark, "products", seed.PRODUCTS)).orderBy("request_id").collect()
    for row, (payload, *_, total, submittable) in zip(preview, PAYLOADS, strict=True):
        assert (row.preview_total, row.can_submit) == (pytest.approx(total), submittable), payload


def test_bad_customers_come_first(spark):
    t = seed.tables(spark)
    asked = seed.requests(spark, *[(ref, lines) for ref in ("abc", "0", "-1", "99", None)
                                   for lines in ("nope", '[{"product_id":1,"quantity":1}]')])
    decided = intake.order_intake(asked, t["customers"], t["products"])
    assert {r.status for r in decided.collect()} == {"no_customer"} and decided.count() == 10


def test_parsed_lines(spark):
    parsed = intake.order_lines_parse(seed.requests(
        spark, ("1", '[{"product_id":1,"quantity":2},5]'), ("1", "[]"), ("1", '[{"product_id":7,"quantity":1}]')))
    assert sorted(seed.rows(parsed), key=repr) == [
        (1, 1, 1, 2, False), (1, 2, None, None, False), (2, None, None, None, False), (3, 1, 7, 1, True)]


def test_placed_orders_continue_the_ids(spark, asked):
    t = seed.tables(spark)
    decided = intake.order_intake(asked, t["customers"], t["products"])
    orders, items = intake.place_orders(
        decided, intake.last_id(t["shop_orders"], "order_id"), intake.last_id(t["order_items"], "order_item_id"))
    want = [i + 1 for i, p in enumerate(PAYLOADS) if p[1] == "accepted"]
    assert seed.rows(orders.orderBy("order_id"), "order_id", "request_id", "risk_score") == [
        (4 + n, request, 50.0) for n, request in enumerate(want)]
    lines = items.orderBy("order_item_id").collect()
    assert [r.order_item_id for r in lines] == list(range(4, 4 + len(lines)))
    assert [r.order_id for r in lines] == sorted(r.order_id for r in lines)
    sums = {r[0]: r[1] for r in seed.rows(items.groupBy("order_id").agg(F.sum("line_total")))}
    assert all(sums[r.order_id] == pytest.approx(r.order_total) for r in orders.collect())


def test_placing_into_empty_tables_starts_at_one(spark):
    t = seed.tables(spark, shop_orders=[], order_items=[])
    decided = intake.order_intake(
        seed.requests(spark, ("1", '[{"product_id":1,"quantity":2}]')), t["customers"], t["products"])
    orders, items = intake.place_orders(
        decided, intake.last_id(t["shop_orders"], "order_id"), intake.last_id(t["order_items"], "order_item_id"))
    assert seed.rows(orders, "order_id") == [(1,)] and seed.rows(items, "order_item_id") == [(1,)]


def stored(spark, out):
    return (sorted(seed.rows(placed(spark, out, "orders"), "order_id", "request_id", "order_total")),
            sorted(seed.rows(placed(spark, out, "items"), "order_item_id", "order_id", "quantity")))


def test_stream_applies_each_request_once(spark, tmp_path):
    t = seed.tables(spark)
    out, inbox = str(tmp_path / "out"), str(tmp_path / "in")
    line = '[{"product_id":1,"quantity":%d},{"product_id":2,"quantity":1}]'
    all_requests = seed.requests(spark, *[("1", line % (i + 1)) for i in range(6)], ("x", line % 1))
    for part in ("request_id <= 2", "request_id in (3, 4, 5)", "request_id > 5"):
        all_requests.where(part).write.mode("append").parquet(inbox)
        intake_stream(spark, inbox, t, out, str(tmp_path / "cp")).awaitTermination()
    intake_stream(spark, inbox, t, out, str(tmp_path / "cp")).awaitTermination()
    orders, items = stored(spark, out)
    assert [o[:2] for o in orders] == [(3 + i, i) for i in range(1, 7)]
    assert [i[0] for i in items] == list(range(4, 16))
    decisions = placed(spark, out, "decisions")
    assert decisions.count() == 7


def test_replayed_and_half_written_batches(spark, tmp_path):
    t = seed.tables(spark)
    out = str(tmp_path / "out")
    line = '[{"product_id":1,"quantity":1}]'
    requests = seed.requests(spark, ("1", line), ("2", line), ("1", line))
    first, second = requests.where("request_id = 1"), requests.where("request_id > 1")
    apply_batch(first, 0, t, out)
    # A crash after writing orders: no marker, so nothing of it is visible.
    first.write.parquet(f"{out}/orders/batch=direct-1")
    assert len(stored(spark, out)[0]) == 1
    apply_batch(second, 1, t, out)
    once = stored(spark, out)
    apply_batch(second, 1, t, out)
    assert stored(spark, out) == once and [o[0] for o in once[0]] == [4, 5, 6]


def test_empty_batch(spark, tmp_path):
    t = seed.tables(spark)
    out = str(tmp_path / "out")
    requests = seed.requests(spark, ("x", "nope"), ("1", '[{"product_id":1,"quantity":1}]'))
    apply_batch(requests.where("request_id = 1"), 0, t, out)
    apply_batch(requests.where("request_id = 2"), 1, t, out)
    assert [o[0] for o in stored(spark, out)[0]] == [4]
    assert dt.datetime(2026, 2, 1, 0, 1) == placed(spark, out, "orders").first().order_datetime


def test_a_request_delivered_again_is_one_request(spark, tmp_path):
    t = seed.tables(spark)
    out = str(tmp_path / "out")
    line = '[{"product_id":1,"quantity":2}]'
    requests = seed.requests(spark, ("1", line), ("2", line))
    decided = intake.order_intake(requests.unionAll(requests), t["customers"], t["products"]).collect()
    assert [(r.order_total, len(r.lines)) for r in decided] == [(9.0, 1)] * 2
    apply_batch(requests.where("request_id = 1"), 0, t, out)
    apply_batch(requests, 1, t, out)
    # A new checkpoint starts again at batch 0.
    apply_batch(requests.unionAll(seed.requests(spark, ("1", line), ("1", line), ("2", line)).where("request_id = 3")), 0, t, out, "other")
    orders, _ = stored(spark, out)
    assert [o[:2] for o in orders] == [(4, 1), (5, 2), (6, 3)]


def test_ids_given_out_by_another_writer_and_a_retry(spark, tmp_path, monkeypatch):
    t = seed.tables(spark)
    out = str(tmp_path / "out")
    requests = seed.requests(spark, *[("1", '[{"product_id":1,"quantity":1}]')] * 3)
    apply_batch(requests.where("request_id = 1"), 0, t, out)
    other = {**t, "shop_orders": t["shop_orders"].unionAll(t["shop_orders"].limit(1).replace(t["shop_orders"].first().order_id, 9, "order_id"))}

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr("packhouse.streaming.intake.place_orders", crash)
        with pytest.raises(RuntimeError):
            apply_batch(requests.where("request_id = 2"), 1, other, out)
    # The retry continues from the ids that were written down, whatever the tables say by now.
    apply_batch(requests.where("request_id = 2"), 1, t, out)
    apply_batch(requests.where("request_id = 3"), 2, t, out)
    assert [o[:2] for o in stored(spark, out)[0]] == [(4, 1), (10, 2), (11, 3)]


def test_null_price_counts_as_zero(spark):
    t = seed.tables(spark)
    products = t["products"].withColumn("price", F.when(F.col("product_id") == 1, F.lit(float("nan"))).when(
        F.col("product_id") == 2, F.col("price")))
    requests = seed.requests(spark, ("1", '[{"product_id":1,"quantity":2},{"product_id":3,"quantity":1}]'))
    (decided,) = intake.order_intake(requests, t["customers"], products).collect()
    assert decided.order_total == 0.0 and [line.unit_price for line in decided.lines] == [0.0, 0.0]
    assert intake.cart_preview(requests, products).first().preview_total == 0.0


def scanned(df):
    """Rows that the scans of an executed query put out, and the number of files they had."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
    leaves = plan.collectLeaves()
    found = [leaves.apply(i).metrics() for i in range(leaves.length())]
    return [sum(m.get(name).get().value() for m in found if m.contains(name)) for name in ("numOutputRows", "numFiles")]


def test_looking_up_new_ids_reads_nothing_however_many_batches_came_before(spark, tmp_path):
    own, state = IntakeState(spark, str(tmp_path)), applied.State()
    read = []
    for batch in range(12):
        ids = spark.range(batch * 1000, (batch + 1) * 1000).withColumnRenamed("id", "request_id")
        assert own.known(ids, state) is None
        state = own.commit(state, "s", batch, ids, 0, 0)
        # An old id among new ones is still found, from the one run that can have it.
        known = own.known(spark.createDataFrame([(5,), (10**6,)], "request_id long"), state)
        read.append((scanned(known)[1], len(state.runs)))
        assert [r.request_id for r in known.collect()] == [5]
    assert [r[1] for r in read] == [1, 2, 3, 4, 5, 6, 7, 1, 2, 3, 4, 5]
    assert {r[0] for r in read} == {1} and sum(r.rows for r in state.runs) == 12_000
    assert IntakeState(spark, str(tmp_path)).read() == state
    assert len(list((tmp_path / "state").glob("v*"))) == 2 and len(list((tmp_path / "applied").iterdir())) == 5


def test_bloom_filters_answer_for_ids_inside_the_range(spark, tmp_path, monkeypatch):
    own = IntakeState(spark, str(tmp_path))
    ids = spark.range(0, 400_000).select((F.col("id") * 2).alias("request_id"))
    state = own.commit(applied.State(), "s", 0, ids, 0, 0)
    odd = spark.createDataFrame([(2 * i * 1000 + 1,) for i in range(30)], "request_id long")
    few, files = scanned(own.known(odd, state))
    monkeypatch.setattr(applied, "FEW_IDS", 5)
    ranged = scanned(own.known(odd, state))[0]
    assert files > 0 and few == 0 < ranged
    assert own.fresh(odd.union(spark.createDataFrame([(4000,), (None,)], "request_id long")), state).count() == 31


def test_merging_keeps_every_id_and_a_crash_keeps_the_old_state(spark, tmp_path, monkeypatch):
    own, state = IntakeState(spark, str(tmp_path)), applied.State()
    for batch in range(7):
        ids = spark.createDataFrame([(batch + 7 * i,) for i in range(20)], "request_id long")
        state = own.commit(state, "s", batch, ids, batch, batch)
    monkeypatch.setattr(applied, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        own.commit(state, "s", 7, spark.createDataFrame([(999,)], "request_id long"), 7, 7)
    monkeypatch.undo()
    assert own.read() == state and state.streams == {"s": 6} and len(state.runs) == 7
    state = own.commit(state, "s", 7, spark.createDataFrame([(999,)], "request_id long"), 7, 7)
    assert [(r.level, r.rows) for r in state.runs] == [(1, 141)]
    asked = spark.range(0, 1000).withColumnRenamed("id", "request_id")
    assert own.fresh(asked, state).count() == 1000 - 141


def test_the_last_ids_of_stored_tables_are_read_only_beyond_the_state(spark, tmp_path):
    t = seed.tables(spark)
    spark.range(1, 50_001).select(F.col("id").alias("order_id")).write.parquet(str(tmp_path / "orders"))
    stored = spark.read.parquet(str(tmp_path / "orders"))
    assert scanned(stored.where(F.col("order_id") > 50_000).agg(F.max("order_id")))[0] == 0
    from packhouse.streaming.intake import _last_ids

    tables = {**t, "shop_orders": stored}
    assert _last_ids(tables, applied.State(last_order=50_000, last_item=1))[0] == 50_000
    assert _last_ids(tables, applied.State(last_order=49_000, last_item=1)) == (50_000, 3)
