import datetime as dt
import math
from fractions import Fraction

import pytest
import seed
from pyspark.sql import functions as F

from packhouse.functions.scalars import hash_score
from packhouse.operators import scoring
from packhouse.sources.store import VersionedStore, part_of
from packhouse.sources.tables import load_tables

OLD = dt.datetime(2025, 1, 1)


def batch(spark, *rows):
    return spark.createDataFrame(
        rows, "order_id long, late_delivery_probability double, predicted_late_delivery int,"
              " fraud_probability double, predicted_fraud int, seq int")


def test_upsert_keeps_replaces_and_repeats(spark):
    old = seed.table(spark, "order_predictions", [(2, 0.3, 1, 0.2, 0, OLD), (3, 0.9, 1, 0.9, 1, OLD)])
    new = batch(spark, (1, 0.0, 0, 0.6, 1, 1), (3, 0.0, 0, 0.1, 0, 1), (3, 0.0, 0, 0.7, 1, 2))
    once = scoring.upsert_predictions(old, new, seed.NOW, order_by="seq")
    now = dt.datetime(2026, 1, 31)
    want = [(1, 0.0, 0, 0.6, 1, now), (2, 0.3, 1, 0.2, 0, OLD), (3, 0.0, 0, 0.7, 1, now)]
    assert sorted(seed.rows(once)) == want
    assert sorted(seed.rows(scoring.upsert_predictions(once, new, seed.NOW, order_by="seq"))) == want


def test_upsert_never_repeats_an_order(spark):
    new = batch(spark, (1, 0.0, 0, 0.2, 0, 1), (1, 0.0, 0, 0.6, 1, 1), (1, 0.0, 0, 0.6, 1, 2))
    result = scoring.upsert_predictions(seed.table(spark, "order_predictions", []), new, seed.NOW)
    assert seed.rows(result, "order_id", "fraud_probability") == [(1, 0.6)]


def test_run_commits_and_lists_flagged(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "p"))
    t = seed.tables(spark, order_predictions=[(2, 0.3, 1, 0.2, 0, OLD)])
    run = scoring.scoring_run(spark, t, scoring.HashScorer(), seed.NOW, store)
    assert seed.rows(run.summary) == [(True, "mock", seed.NOW, 2, 2, None)]
    assert seed.rows(run.flagged, "order_id") == [(3,), (1,)]
    first = sorted(seed.rows(store.read()))
    assert [r[0] for r in first] == [1, 2, 3]
    again = scoring.scoring_run(spark, t, scoring.HashScorer(), seed.NOW, store)
    assert (again.version, sorted(seed.rows(store.read()))) == (2, first)


def test_failed_scorer_leaves_the_table(spark, tmp_path):
    class Broken:
        key = "python"

        def score(self, tables):
            return tables["shop_orders"].select(F.raise_error(F.lit("no model")).alias("order_id"))

    store = VersionedStore(spark, str(tmp_path / "p"))
    run = scoring.scoring_run(spark, seed.tables(spark), Broken(), seed.NOW, store)
    row = run.summary.first()
    assert (row.ok, row.orders_scored, store.current_version()) == (False, None, 0)
    assert row.error_message


def test_failed_list_still_counts_as_success(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "p"))
    t = seed.tables(spark)
    t["customers"] = t["customers"].drop("full_name")
    run = scoring.scoring_run(spark, t, scoring.HashScorer(), seed.NOW, store)
    assert (run.summary.first().ok, run.flagged, run.version) == (True, None, 1)


def test_unmarked_version_is_not_read(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "p"))
    store.commit(spark.range(1))
    spark.range(5).write.parquet(f"{store.root}/data/v2-abandoned")
    assert store.read().count() == 1
    assert store.commit(spark.range(2)) == 2 and store.read().count() == 2


def test_daily_scoring_repeats_to_the_same_table(spark, tmp_path):
    folder = str(tmp_path / "shop")
    for name, df in seed.tables(spark).items():
        df.write.parquet(f"{folder}/{name}")
    assert sorted(load_tables(spark, folder)) == sorted(seed.ROWS)
    store = VersionedStore(spark, f"{folder}/_predictions")
    results = []
    for _ in range(2):
        summary = scoring.daily_scoring(spark, folder, scoring.HashScorer(), seed.NOW)
        results.append((seed.rows(summary), sorted(seed.rows(store.read()))))
    assert results[0] == results[1]


def test_scorer_choice():
    scorers = {"mock": 1, "python": 2}
    pick = scoring.choose_scorer
    assert [pick(scorers, s, d) for s, d in (
        (" MOCK ", False), ("python", True), (None, True), (None, False), ("other", True))] == [1, 2, 1, 2, 1]
    assert scoring.threshold_setting({}) == 0.5 and scoring.threshold_setting({"FRAUD_THRESHOLD": "0.7"}) == 0.7


def test_custom_scorer_with_pandas(spark, tmp_path):
    class Half:
        key = "half"

        def score(self, tables):
            def rows(batches):
                for b in batches:
                    yield b.assign(late_delivery_probability=0.0, predicted_late_delivery=0, fraud_probability=0.5,
                                   predicted_fraud=1)
            return tables["shop_orders"].select("order_id").mapInPandas(
                rows, "order_id long, late_delivery_probability double, predicted_late_delivery int,"
                      " fraud_probability double, predicted_fraud int")

    run = scoring.scoring_run(spark, seed.tables(spark), Half(), seed.NOW, VersionedStore(spark, str(tmp_path / "p")))
    assert run.summary.first().orders_scored == 3
    assert pytest.approx(0.5) == run.predictions.first().fraud_probability


def test_upsert_with_repeats_nulls_and_no_sequence(spark):
    old = seed.table(spark, "order_predictions", [(1, .1, 0, .1, 0, OLD), (2, .2, 0, .2, 0, OLD)])
    new = spark.createDataFrame(
        [(1, .5, 1, .5, 1, 3), (1, .6, 1, .6, 1, None), (1, .4, 1, .4, 1, 2), (3, .3, 0, .3, 0, None), (None, .9, 1, .9, 1, 1)],
        "order_id long, late_delivery_probability double, predicted_late_delivery int, fraud_probability double,"
        " predicted_fraud int, seq int")
    rows = {r.order_id: r.fraud_probability for r in scoring.upsert_predictions(old, new, seed.NOW, "seq").collect()}
    assert rows == {1: .5, 2: .2, 3: .3}
    rows = {r.order_id: r.fraud_probability for r in scoring.upsert_predictions(old, new, seed.NOW).collect()}
    assert rows == {1: .6, 2: .2, 3: .3}


def test_store_with_unreadable_markers_races_and_expiry(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"))
    assert store.commit(spark.range(1)) == 1
    (tmp_path / "s" / "commits" / "v2").write_text("{\"version\": 2, ")
    assert store.read().count() == 1
    assert store.commit(spark.range(3)) == 3 and store.read().count() == 3
    late = VersionedStore(spark, str(tmp_path / "s"))
    late.current_version = iter([0, 3]).__next__  # it looked before the first commit
    with pytest.raises(RuntimeError, match="another writer"):
        late.commit(spark.range(9))
    before = store.read().count()
    store.expire()
    assert store.read().count() == before and len(list((tmp_path / "s" / "data").iterdir())) == 1
    with pytest.raises(ValueError):
        store.expire(0)


def test_score_with_nulls_nan_and_large_totals(spark):
    rows = [(5, 7, 1e16, "2026-01-01 00:00:00"), (5, None, float("nan"), "2026-01-01 00:00:00"), (5, 0, 0.0, "2026-01-01 00:00:00"),
            (10**18, 3, 1e300, ""), (5, 7, 12.5, ""), (5, 7, -1e9, ""), (1, 1, float("inf"), None)]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, o long, c long, t double, m string")
    scores = [r.s for r in table.orderBy("i").select(hash_score(F.col("o"), F.col("c"), F.col("t"), F.col("m")).alias("s")).collect()]

    def exact(o, c, t, text):
        seed_ = o * 374761 + (c or 0) * 66041 + math.floor(Fraction(t) * 100 + Fraction(1, 2)) * 104729
        seed_ = (seed_ + sum(ord(x) * (k + 1) for k, x in enumerate(text))) % 2**32 if text else seed_
        return min(.99, max(.01, seed_ % 10000 / 10000 if seed_ >= 0 else 0))

    assert scores[0] == exact(*rows[0]) and scores[1] == scores[2] == exact(*rows[2])
    assert scores[4] == exact(*rows[4]) and scores[5] == 0.01 and all(.01 <= s <= .99 for s in scores)


def test_missing_tables_are_named(spark, tmp_path):
    folder = tmp_path / "shop"
    for name, table in seed.tables(spark).items():
        if name not in ("products", "shipments"):
            table.write.parquet(str(folder / name))
    row = scoring.daily_scoring(spark, str(folder), scoring.HashScorer(), seed.NOW).first()
    assert (row.ok, row.provider, row.error_message) == (False, "unavailable", "missing tables: products, shipments")
    assert VersionedStore(spark, f"{folder}/_predictions").current_version() == 0


def predictions(spark, ids, probability=.5):
    return spark.createDataFrame([(i, 0.0, 0, probability, 1) for i in ids], "order_id long, late_delivery_probability double,"
                                 " predicted_late_delivery int, fraud_probability double, predicted_fraud int")


def upserted(old, new):
    return scoring.upsert_predictions(old, new, seed.NOW)


def test_a_merge_writes_only_the_parts_it_touches(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "p"))
    old = upserted(seed.table(spark, "order_predictions", []), predictions(spark, range(1000)))
    assert store.merge(predictions(spark, [1000]), "order_id", upserted, old) == 1
    first = store.manifest(1)
    assert first["n_parts"] == len(first["folders"]) == 64 and store.read().count() == 1001
    one = [r[0] for r in spark.range(1000).where(part_of("id", 64) == 7).collect()][:3]
    assert store.merge(predictions(spark, one, .9), "order_id", upserted) == 2
    second = store.manifest(2)
    fresh = [f for f in second["folders"] if f not in first["folders"]]
    assert len(fresh) == 1 and fresh[0].endswith("store_part=7") and len(second["folders"]) == 64
    folder = tmp_path / "p" / fresh[0].split("/store_part")[0]
    assert [f.name for f in folder.iterdir() if f.name.startswith("store_part")] == ["store_part=7"]
    found = {r.order_id: r.fraud_probability for r in store.read().collect()}
    assert len(found) == 1001 and {i for i, p in found.items() if p == .9} == set(one)
    # A new order in an empty table's missing part, and a batch without rows.
    assert store.merge(predictions(spark, []), "order_id", upserted) == 2
    store.expire()
    assert store.read().count() == 1001
    assert sorted(f"data/{p.relative_to(tmp_path / 'p' / 'data')}" for p in (tmp_path / "p" / "data").glob("*/store_part=*")) == sorted(
        second["folders"])


def test_a_crash_between_parts_and_manifest_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = VersionedStore(spark, str(tmp_path / "p"))
    store.merge(predictions(spark, range(50)), "order_id", upserted, seed.table(spark, "order_predictions", []))
    before = sorted(seed.rows(store.read()))
    monkeypatch.setattr("packhouse.sources.store.publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.merge(predictions(spark, range(20), .9), "order_id", upserted)
    monkeypatch.undo()
    assert store.current_version() == 1 and sorted(seed.rows(store.read())) == before
    assert store.merge(predictions(spark, range(20), .9), "order_id", upserted) == 2
    assert store.read().where("fraud_probability = 0.9").count() == 20
    store.expire()
    assert store.read().count() == 50


def test_a_store_written_whole_goes_over_to_parts_and_parts_may_empty(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "p"))
    store.commit(upserted(seed.table(spark, "order_predictions", []), predictions(spark, range(10))))
    assert store.merge(predictions(spark, [3, 11], .9), "order_id", upserted, parts=4) == 2
    assert store.read().count() == 11 and store.manifest(2)["n_parts"] == 4
    gone = lambda old, new: old.join(new, "order_id", "left_anti")
    assert store.merge(predictions(spark, range(12)), "order_id", gone) == 3
    assert store.read().count() == 0 and store.manifest(3)["folders"] == []
    assert store.merge(predictions(spark, [5]), "order_id", upserted) == 4
    assert seed.rows(store.read(), "order_id") == [(5,)]
