from collections import Counter

import pytest

from packhouse.llm.rollups import TokenRollup, count_tokens, counted, deletes, inserts, revisions
from packhouse.sources import store

COUNTS = "source string, lang string, tokenizer string, tokens long"


def rows(*values):
    return [tuple(v) for v in values]


def totals(rollup):
    return {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()}


def test_signed_batches_add_up_and_replays_change_nothing(spark, tmp_path):
    rollup = TokenRollup(spark, str(tmp_path))
    assert totals(rollup) == {}
    first = rows(("a", "en", "v1", 5), ("a", "en", "v1", 7), ("b", None, "v1", 1), (None, None, None, None))
    assert rollup.apply("1", inserts(spark.createDataFrame(first, COUNTS)))
    assert totals(rollup) == {("a", "en", "v1"): (2, 12), ("b", None, "v1"): (1, 1), (None, None, None): (1, 0)}
    gone = spark.createDataFrame(first[2:], COUNTS)
    assert rollup.apply("2", deletes(gone)) and not rollup.apply("2", deletes(gone)) and not rollup.apply("1", inserts(gone))
    before, after = first[:1], rows(("a", "en", "v2", 9))
    change = revisions(spark.createDataFrame(before, COUNTS), spark.createDataFrame(after, COUNTS))
    assert rollup.apply("weird/id \n", change) and not TokenRollup(spark, str(tmp_path)).apply("weird/id \n", change)
    assert totals(rollup) == {("a", "en", "v1"): (1, 7), ("a", "en", "v2"): (1, 9)}
    assert rollup.apply("empty", inserts(spark.createDataFrame([], COUNTS))) and len(totals(rollup)) == 2


def test_a_batch_that_loses_the_race_or_crashes_leaves_no_trace(spark, tmp_path, monkeypatch):
    rollup = TokenRollup(spark, str(tmp_path))
    one = inserts(spark.createDataFrame(rows(("a", "en", "v1", 5)), COUNTS))

    def crash(*_):
        raise RuntimeError("driver lost")

    monkeypatch.setattr("packhouse.llm.rollups.publish", crash)
    with pytest.raises(RuntimeError):
        rollup.apply("1", one)
    monkeypatch.setattr("packhouse.llm.rollups.publish", store.publish)
    assert totals(rollup) == {} and rollup.apply("1", one)
    # Two writers that both saw no marker: the second one's sums stay unread.
    late = TokenRollup(spark, str(tmp_path))
    monkeypatch.setattr(late, "commits", lambda: spark.createDataFrame([], "batch string, path string"))
    assert not late.apply("1", one)
    assert totals(rollup) == {("a", "en", "v1"): (1, 5)}


def batch(spark, n):
    return inserts(spark.createDataFrame(rows((f"s{n % 2}", "en", "v1", n), (None, None, "v1", 1)), COUNTS))


def test_a_snapshot_takes_the_place_of_the_batches_before_it(spark, tmp_path):
    rollup = TokenRollup(spark, str(tmp_path))
    assert not rollup.compact()
    rollup.clean()
    for n in range(6):
        assert rollup.apply(f"b{n}", batch(spark, n))
        if n in (2, 4):
            want = totals(rollup)
            assert rollup.compact() and not rollup.compact() and totals(rollup) == want
            rollup.clean()
            assert totals(rollup) == want
    assert totals(rollup) == {("s0", "en", "v1"): (3, 6), ("s1", "en", "v1"): (3, 9), (None, None, "v1"): (6, 6)}
    assert not any(rollup.apply(f"b{n}", batch(spark, n)) for n in range(6))
    # One snapshot, and the marker and sums of the batch since.
    assert [len(store.children(spark, f"{tmp_path}/{f}")) for f in ("snapshots", "compacted", "commits", "changes")] == [1, 1, 1, 1]


def test_totals_of_many_batches_read_the_snapshot(spark, tmp_path):
    rollup = TokenRollup(spark, str(tmp_path))
    for n in range(12):
        rollup.apply(f"b{n}", batch(spark, n))
    assert len(rollup.totals().inputFiles()) >= 12
    assert rollup.compact()
    files = rollup.totals().inputFiles()
    assert files and all("/compacted/" in f for f in files) and len(files) <= 8


def test_compaction_that_crashes_or_loses_changes_nothing(spark, tmp_path, monkeypatch):
    rollup = TokenRollup(spark, str(tmp_path))
    rollup.apply("1", batch(spark, 1))
    want = totals(rollup)
    for lost in (lambda *_: False, lambda *_: 1 / 0):
        with monkeypatch.context() as m:
            m.setattr("packhouse.llm.rollups.publish", lost)
            try:
                assert not rollup.compact()
            except ZeroDivisionError:
                pass
        assert totals(rollup) == want
    # A writer that looked before the compaction and commits after the cleaning: its batch counts once.
    late = TokenRollup(spark, str(tmp_path))
    assert rollup.compact()
    rollup.clean()
    monkeypatch.setattr(late, "_snapshot", lambda: (0, None))
    late.apply("1", batch(spark, 1))
    assert totals(rollup) == want


def test_counts(spark):
    docs = spark.createDataFrame([("a é\x0bb-1!?", "s", "en"), (None, "s", None), ("", None, "en")], "text string, source string, lang string")
    assert [r.n for r in docs.select(count_tokens(docs.text, "words-1").alias("n")).collect()] == [3, 0, 0]
    assert [r.n for r in docs.select(count_tokens(docs.text, "pieces-1").alias("n")).collect()] == [6, 0, 0]
    assert Counter(counted(docs, "words-1").columns) == Counter(["source", "lang", "tokenizer", "tokens"])
