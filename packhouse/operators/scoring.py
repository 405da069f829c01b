"""Scoring open orders and keeping the predictions table up to date."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime
from typing import Protocol

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packhouse.functions.scalars import hash_score_at
from packhouse.operators.features import Tables, fraud_features_serving
from packhouse.operators.model import (
    THRESHOLD, LinearParameters, load_features, load_model, predict, predict_linear, require_features,
)
from packhouse.operators.orders import open_orders_for_scoring
from packhouse.operators.queue import fraud_flagged_open_orders
from packhouse.schemas import FRAUD_FEATURES
from packhouse.sources.shared import materialize
from packhouse.sources.store import VersionedStore
from packhouse.sources.tables import load_available, missing_tables

SCORES = ["late_delivery_probability", "predicted_late_delivery", "fraud_probability", "predicted_fraud"]


class Scorer(Protocol):
    """Scores all open orders: one row per order with `order_id` and the four score columns."""

    key: str

    def score(self, tables: Tables) -> DataFrame: ...


class ChangeScorer(Scorer, Protocol):
    """A scorer whose score of an order depends on the order's row of `inputs` alone.

    `identity` differs between scorers that may score an equal row differently.
    """

    @property
    def identity(self) -> str: ...

    def inputs(self, tables: Tables) -> DataFrame: ...

    def score_inputs(self, rows: DataFrame) -> DataFrame: ...


def _prediction_rows(scored: DataFrame, prob: str, pred: str) -> DataFrame:
    """Score rows of a fraud scorer; the late columns are always 0."""
    return scored.select(
        "order_id", F.lit(0.0).alias("late_delivery_probability"), F.lit(0).alias("predicted_late_delivery"),
        F.col(prob).alias("fraud_probability"), F.col(pred).cast("int").alias("predicted_fraud"))


def score_open_orders_hash(tables: Tables) -> DataFrame:
    """The deterministic hash score; fraud is flagged from 0.5 whatever the threshold setting."""
    return _hash_scored(open_orders_for_scoring(tables["shop_orders"], tables["shipments"], ordered=False))


def _hash_scored(waiting: DataFrame) -> DataFrame:
    scored = waiting.withColumn("prob", hash_score_at(
        F.col("order_id"), F.col("customer_id"), F.col("total_value"), F.col("order_timestamp")))
    return _prediction_rows(scored.withColumn("pred", F.col("prob") >= 0.5), "prob", "pred")


def score_open_orders_model(tables: Tables, model: PipelineModel | LinearParameters,
                            threshold: float = THRESHOLD, features: list[str] | None = None) -> DataFrame:
    """Serving features through a fitted pipeline or its plain parameters."""
    return _model_scored(fraud_features_serving(tables), model, threshold, features)


def _model_scored(rows: DataFrame, model: PipelineModel | LinearParameters, threshold: float, features: list[str] | None) -> DataFrame:
    rows = require_features(rows, features or FRAUD_FEATURES)
    apply = predict_linear if isinstance(model, LinearParameters) else predict
    return _prediction_rows(apply(model, rows, threshold), "prob", "pred")


@dataclass(frozen=True)
class HashScorer:
    key: str = "mock"

    def score(self, tables: Tables) -> DataFrame:
        return score_open_orders_hash(tables)

    @property
    def identity(self) -> str:
        return self.key

    def inputs(self, tables: Tables) -> DataFrame:
        return open_orders_for_scoring(tables["shop_orders"], tables["shipments"], ordered=False)

    def score_inputs(self, rows: DataFrame) -> DataFrame:
        return _hash_scored(rows)


@dataclass(frozen=True)
class ModelScorer:
    model: PipelineModel | LinearParameters
    threshold: float = THRESHOLD
    features: list[str] | None = None
    key: str = "python"

    @classmethod
    def stored(cls, spark: SparkSession, path: str, threshold: float = THRESHOLD) -> "ModelScorer":
        """The model and feature list that `train_and_store` left under `path`."""
        return cls(load_model(f"{path}/model"), threshold, load_features(spark, path))

    def score(self, tables: Tables) -> DataFrame:
        return score_open_orders_model(tables, self.model, self.threshold, self.features)

    @property
    def identity(self) -> str:
        """A fitted pipeline keeps its uid when it is stored; a new fit has a new one."""
        model = self.model if isinstance(self.model, LinearParameters) else self.model.uid
        return f"{self.key}:{model!r}:{self.threshold!r}:{self.features!r}"

    def inputs(self, tables: Tables) -> DataFrame:
        return fraud_features_serving(tables)

    def score_inputs(self, rows: DataFrame) -> DataFrame:
        return _model_scored(rows, self.model, self.threshold, self.features)


def threshold_setting(environ: Mapping[str, str] = os.environ) -> float:
    return float(environ.get("FRAUD_THRESHOLD", THRESHOLD))


def choose_scorer(scorers: Mapping[str, Scorer], setting: str | None, shared_database: bool) -> Scorer:
    """The scorer named by `setting` ("mock" or "python"); otherwise by where the tables live."""
    named = (setting or "").strip().lower()
    if named not in ("mock", "python"):
        named = "mock" if shared_database else "python"
    return scorers[named]


def upsert_predictions(old: DataFrame, new: DataFrame, run_ts: datetime | str, order_by: str | None = None) -> DataFrame:
    """Replace all scores of the orders in `new` and keep every other row of `old`.

    If `new` repeats an order, the row with the largest `order_by` wins (nulls lose, ties and a missing column go to
    the largest scores): the result has one row per order. Rows without order id are left out. The choice is a mergeable aggregate,
    so a much repeated order is reduced before it is shuffled, and the join that follows uses
    its partitioning. The full outer join reads each side once.
    """
    scores = F.struct(*SCORES)
    rank = [F.col(order_by).isNotNull(), F.col(order_by)] if order_by else [F.lit(True)]
    winner = F.max_by(scores, F.struct(*rank, scores))
    batch = new.filter("order_id is not null").groupBy("order_id").agg(winner.alias("_new"), F.lit(True).alias("_fresh"))
    fresh = F.col("_fresh")
    stamp = F.lit(str(run_ts)).cast("timestamp_ntz")
    return old.join(batch, "order_id", "full_outer").select(
        "order_id",
        *[F.when(fresh, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in SCORES],
        F.when(fresh, stamp).otherwise(F.col("prediction_timestamp")).alias("prediction_timestamp"))


@dataclass(frozen=True)
class ScoringRun:
    """`summary` has one row; the flagged orders are a table, as there may be very many."""

    predictions: DataFrame | None
    flagged: DataFrame | None
    summary: DataFrame
    version: int | None


SUMMARY = ("ok boolean, provider string, timestamp string, orders_scored long, flagged_orders long, "
           "error_message string")


def scoring_run(spark: SparkSession, tables: Tables, scorer: Scorer, run_ts: datetime | str,
                store: VersionedStore) -> ScoringRun:
    """Score, commit the new predictions as a version, and list the flagged open orders.

    Scores are computed once and everything after reads the written rows. The commit writes the store's parts that hold
    scored orders; an empty store begins with the table's predictions. A failing scorer or
    commit leaves the table as it was and is reported; a failing flagged list is left out and named as the error of a
    run that is otherwise good. Without all tables nothing runs: the provider is `unavailable` and the error names them.
    """
    def summary(ok: bool, scored: int | None, flagged: int | None, error: str | None, provider: str = scorer.key) -> DataFrame:
        return spark.createDataFrame([(ok, provider, str(run_ts), scored, flagged, error)], SUMMARY)

    missing = missing_tables(tables)
    if missing:
        error = f"missing tables: {', '.join(missing)}"
        return ScoringRun(tables.get("order_predictions"), None, summary(False, None, None, error, "unavailable"), None)
    current = tables["order_predictions"]
    try:
        stored = store.read()
        current = current if stored is None else stored
        batch = materialize(scorer.score(tables), "scores")
        scored = batch.count()
        version = store.merge(batch, "order_id", lambda old, new: upsert_predictions(old, new, run_ts), current)
    except Exception as error:  # any failure of the scorer or the write is the run's result
        return ScoringRun(current, None, summary(False, None, None, str(error)), None)
    try:
        predictions = store.read()
        flagged = fraud_flagged_open_orders(
            tables["shop_orders"], tables["customers"], tables["shipments"], predictions)
        count = flagged.count()
    except Exception as error:  # the scores are committed: the run succeeded without the list
        return ScoringRun(store.read(), None, summary(True, scored, None, f"flagged list: {error}"), version)
    return ScoringRun(predictions, flagged, summary(True, scored, count, None), version)


def input_digests(rows: DataFrame, identity: str) -> DataFrame:
    """`rows` with a 16-byte digest of the scorer and every column but the order id."""
    fields = F.struct(*[c for c in rows.columns if c != "order_id"])
    written = F.concat(F.lit(f"{identity}\n"), F.to_json(fields, {"ignoreNullFields": "false"}))
    return rows.withColumn("digest", F.unhex(F.md5(written)))


@dataclass(frozen=True)
class ChangeRun:
    """`scored` orders were new, changed or reopened; `closed` ones are no longer open. Without any, `version` is the old one."""

    scored: int
    closed: int
    version: int


def scoring_by_change(tables: Tables, scorer: ChangeScorer, run_ts: datetime | str,
                      store: VersionedStore, digests: VersionedStore) -> ChangeRun:
    """Score the open orders whose inputs, or whose scorer, are not those of the last run; all other predictions stay.

    The scores are those of a full run; the time of a prediction is that of the run which made it. `digests` holds a digest of
    the inputs of every order that was open at the last run, so an order that was closed in between is scored anew. Both
    stores are rewritten in the parts that hold changed orders only. Predictions are committed first: a crash before
    the digests' commit makes the next run score the same orders again, to the same values. Rows without order id are not
    scored. A run without changes commits nothing.
    """
    current = input_digests(scorer.inputs(tables).where("order_id is not null"), scorer.identity)
    last = digests.read()
    if last is None:
        changed = current
    else:
        known = last.select("order_id", F.col("digest").alias("_known"))
        changed = current.join(known, "order_id", "full_outer").where(~F.col("digest").eqNullSafe(F.col("_known"))).drop("_known")
    changed = materialize(changed, "changed")
    to_score = changed.where("digest is not null")
    counts = changed.agg(F.count("digest"), F.count(F.lit(1))).first()
    scored, closed = counts[0], counts[1] - counts[0]
    version = store.current_version()
    if scored or not version:
        batch = materialize(scorer.score_inputs(to_score.drop("digest")), "scores")
        version = store.merge(batch, "order_id", lambda old, new: upsert_predictions(old, new, run_ts), tables["order_predictions"])
    if scored or closed:
        def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
            kept = old.join(new.select("order_id"), "order_id", "left_anti")
            return kept.unionByName(new.where("digest is not null").distinct())

        digests.merge(changed.select("order_id", "digest"), "order_id", replaced, changed.select("order_id", "digest").limit(0))
    return ChangeRun(scored, closed, version)


def daily_scoring(spark: SparkSession, folder: str, scorer: Scorer, run_ts: datetime | str,
                  store_root: str | None = None) -> DataFrame:
    """Re-score all open orders of the stored tables; a repeat for the same time changes nothing."""
    store = VersionedStore(spark, store_root or f"{folder.rstrip('/')}/_predictions")
    run = scoring_run(spark, load_available(spark, folder), scorer, run_ts, store)
    return run.summary
