import datetime as dt
import math
import random

import pytest
import seed

from packhouse.operators import maintained, orders, scoring
from packhouse.operators.model import LinearParameters
from packhouse.plans.parameters import FRAUD_PARAMETERS
from packhouse.sources.store import VersionedStore, part_of

START = dt.datetime(2026, 1, 1)
ORDER = "order_id long, customer_id long, order_datetime timestamp_ntz, order_total double"


def order_rows(spark, rows):
    return spark.createDataFrame(rows, ORDER)


def signed(spark, plus=(), minus=()):
    return maintained.inserted(order_rows(spark, list(plus))).unionByName(maintained.deleted(order_rows(spark, list(minus))))


def random_order(pick, i):
    return (i, pick.choice([1, 1, 1, 2, 3, None]), pick.choice([None, *(START + dt.timedelta(days=d) for d in range(4))]),
            pick.choice([None, 0.1, 0.2, 1e9, -3.3]))


def test_random_changes_equal_the_full_aggregate(spark, tmp_path):
    pick = random.Random(3)
    rollup = maintained.customer_rollup(VersionedStore(spark, str(tmp_path / "r")))
    customers = spark.createDataFrame([(1,), (2,), (3,), (9,)], "customer_id long")
    now, n = {}, 0
    for batch in range(1, 6):
        plus = [random_order(pick, n + i) for i in range(8)]
        minus = [now[i] for i in pick.sample(sorted(now), min(len(now), 6))]
        n += 8
        now = {i: r for i, r in now.items() if r not in minus} | {r[0]: r for r in plus}
        current = order_rows(spark, list(now.values()))
        for _ in range(2):
            rollup.apply(signed(spark, plus, minus), "s", batch, current)
        want = sorted(seed.rows(orders.customer_order_stats(customers, current)))
        got = sorted(seed.rows(maintained.customer_order_stats(customers, rollup)))
        assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in want]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-6)
        counts = [sorted(seed.rows(f), key=repr) for f in (maintained.customer_order_counts(rollup), orders.customer_order_counts(current))]
        assert counts[0] == counts[1]


def test_maxima_are_looked_up_only_where_they_may_be_lost(spark, tmp_path):
    rollup = maintained.customer_rollup(VersionedStore(spark, str(tmp_path / "r")))
    rows = [(i, i % 2, START + dt.timedelta(days=i), 1.0) for i in range(6)]
    broken = order_rows(spark, rows).selectExpr("raise_error('read') as customer_id", "order_datetime").selectExpr(
        "cast(customer_id as long) as customer_id", "order_datetime")
    rollup.apply(signed(spark, rows), "s", 1, broken)
    rollup.apply(signed(spark, (), rows[:2]), "s", 2, broken)
    last = dict(seed.rows(rollup.read(), "customer_id", "order_datetime"))
    assert last == {0: rows[4][2], 1: rows[5][2]}
    with pytest.raises(Exception, match="read"):
        rollup.apply(signed(spark, (), rows[5:]), "s", 3, broken)
    rollup.apply(signed(spark, (), rows[5:]), "s", 3, order_rows(spark, rows[2:5]))
    assert dict(seed.rows(rollup.read(), "customer_id", "order_datetime")) == {0: rows[4][2], 1: rows[3][2]}


def test_a_group_without_rows_goes_and_odd_totals_leave_no_trace(spark, tmp_path):
    rollup = maintained.customer_rollup(VersionedStore(spark, str(tmp_path / "r")))
    odd, kept = (1, 1, START, math.nan), (2, 1, START, 0.1)
    rollup.apply(signed(spark, [odd, kept, (3, 2, START, 5.0)]), "s", 1, order_rows(spark, [kept]))
    assert math.isnan(dict(seed.rows(rollup.read(), "customer_id", "order_total"))[1])
    rollup.apply(signed(spark, (), [odd, (3, 2, START, 5.0)]), "s", 2, order_rows(spark, [kept]))
    assert seed.rows(rollup.read()) == [(1, 1, 0.1, START)]


def test_too_many_deletions_fail_and_change_nothing(spark, tmp_path):
    rollup = maintained.line_rollup(VersionedStore(spark, str(tmp_path / "r")))
    lines = spark.createDataFrame([(1,), (1,), (2,)], "order_id long")
    rollup.apply(maintained.inserted(lines), "s", 1)
    with pytest.raises(Exception, match="more rows deleted than inserted for order_id 2"):
        rollup.apply(maintained.deleted(lines.unionAll(lines)).where("order_id = 2"), "s", 2)
    assert sorted(seed.rows(rollup.read())) == [(1, 2), (2, 1)]
    rollup.apply(maintained.deleted(lines.where("order_id = 2")), "s", 2)
    assert seed.rows(rollup.read()) == [(1, 2)]


def test_streams_are_counted_apart_and_empty_batches_do_nothing(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "r"))
    rollup = maintained.line_rollup(store)
    assert rollup.read() is None
    one = maintained.inserted(spark.createDataFrame([(7,)], "order_id long"))
    assert [rollup.apply(one, s, n) for s, n in (("a", 1), ("b", 1), ("a", 1), ("a", 2), ("b", 1))] == [1, 2, 2, 3, 3]
    assert rollup.apply(one.limit(0), "a", 3) == 3
    assert seed.rows(rollup.read()) == [(7, 3)]


def test_a_batch_writes_only_the_parts_it_touches(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "r"))
    rollup = maintained.line_rollup(store)
    rollup.apply(maintained.inserted(spark.range(500).selectExpr("id as order_id")), "s", 1)
    before = store.manifest(1)
    rollup.apply(maintained.inserted(spark.createDataFrame([(7,)], "order_id long")), "s", 2)
    after = store.manifest(2)
    part = spark.range(7, 8).select(part_of("id", 64)).first()[0]
    changed = [p for p, a, b in zip(after["parts"], before["folders"], after["folders"]) if a != b]
    assert changed == [part] and after["applied"] == {"s": 2}


def scored(store):
    return {r.order_id: (r.fraud_probability, str(r.prediction_timestamp)[:10]) for r in store.read().collect()}


@pytest.mark.parametrize("scorer", [scoring.HashScorer(), scoring.ModelScorer(FRAUD_PARAMETERS)])
def test_changed_new_and_reopened_orders_are_scored(spark, tmp_path, scorer):
    store, digests = (VersionedStore(spark, str(tmp_path / n)) for n in ("p", "d"))
    t = seed.tables(spark)

    def run(day, **changed):
        state = t | {n: seed.table(spark, n, rows) for n, rows in changed.items()}
        made = scoring.scoring_by_change(state, scorer, f"2026-02-0{day} 00:00:00", store, digests)
        # A full run over the same tables gives the same scores.
        full = {r.order_id: r.fraud_probability for r in scorer.score(state).collect()}
        assert {i: p for i, (p, _) in scored(store).items() if i in full} == full
        return made.scored, made.closed, made.version

    assert run(1) == (2, 0, 1)
    assert run(2) == (0, 0, 1)
    richer = [*seed.ORDERS[:2], (3, 2, dt.datetime(2026, 1, 30), 99.25, 45.0)]
    assert run(3, shop_orders=richer) == (1, 0, 2)
    assert run(4, shop_orders=richer, shipments=[(1, 2, 0), (2, 1, 0)]) == (0, 1, 2)
    assert run(5, shop_orders=richer) == (1, 0, 3)
    assert run(6, shop_orders=[*richer, (4, 3, dt.datetime(2026, 2, 1), 5.0, 1.0)]) == (1, 0, 4)
    assert {i: day for i, (_, day) in scored(store).items()} == {1: "2026-02-05", 3: "2026-02-03", 4: "2026-02-06"}


def test_another_model_scores_everything_again(spark, tmp_path):
    store, digests = (VersionedStore(spark, str(tmp_path / n)) for n in ("p", "d"))
    t = seed.tables(spark)
    other = LinearParameters(**{**FRAUD_PARAMETERS.__dict__, "intercept": 0.5})
    runs = [scoring.scoring_by_change(t, s, seed.NOW, store, digests)
            for s in (scoring.ModelScorer(FRAUD_PARAMETERS), scoring.ModelScorer(other), scoring.ModelScorer(other, 0.9))]
    assert [(r.scored, r.version) for r in runs] == [(2, 1), (2, 2), (2, 3)]


def test_nothing_open_and_a_crash_before_the_digests(spark, tmp_path, monkeypatch):
    store, digests = (VersionedStore(spark, str(tmp_path / n)) for n in ("p", "d"))
    none = seed.tables(spark, shop_orders=[])
    assert scoring.scoring_by_change(none, scoring.HashScorer(), seed.NOW, store, digests).scored == 0
    t = seed.tables(spark)
    with monkeypatch.context() as m:
        m.setattr(digests, "merge", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            scoring.scoring_by_change(t, scoring.HashScorer(), seed.NOW, store, digests)
    first = scored(store)
    assert scoring.scoring_by_change(t, scoring.HashScorer(), seed.NOW, store, digests).scored == 2
    assert scored(store) == first


def test_null_and_missing_values_are_told_apart(spark):
    rows = spark.createDataFrame([(1, None, 1.0), (2, 1.0, None), (3, None, 1.0), (4, math.nan, 1.0)], "order_id long, a double, b double")
    digest = {r.order_id: bytes(r.digest) for r in scoring.input_digests(rows, "x").collect()}
    assert digest[1] == digest[3] and len({digest[i] for i in (1, 2, 4)}) == 3
