"""Batch jobs: `python -m packhouse.jobs score|train|intake ...`, or the same through spark-submit."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence
from datetime import UTC, datetime

from packhouse.operators.features import fraud_features_training, late_delivery_features
from packhouse.operators.model import train_and_store
from packhouse.operators.scoring import HashScorer, ModelScorer, Scorer, choose_scorer, scoring_run, threshold_setting
from packhouse.schemas import FRAUD_FEATURES, FRAUD_LABEL, LATE_FEATURES, LATE_LABEL
from packhouse.session import build_session
from packhouse.sources.store import VersionedStore
from packhouse.sources.tables import load_tables
from packhouse.streaming.intake import intake_stream


def _score(spark, args) -> int:
    """Re-score all open orders; the flagged ones are written as a table, as there may be very many."""
    scorers: dict[str, Scorer] = {"mock": HashScorer()}
    if args.model:
        scorers["python"] = ModelScorer.stored(spark, args.model, threshold_setting())
    scorer = choose_scorer(
        scorers, args.scorer or os.environ.get("SCORING_PROVIDER"), shared_database=not args.model)
    run = scoring_run(
        spark, load_tables(spark, args.tables), scorer, args.run_ts, VersionedStore(spark, args.store))
    row = run.summary.first()
    if not row.ok:
        print(f"ERROR: {row.error_message}", file=sys.stderr)
    print(f"RESULT orders_scored={row.orders_scored or 0}")
    print(f"RESULT fraud_flagged_orders={row.flagged_orders or 0}")
    if run.flagged is not None and args.flagged:
        run.flagged.write.mode("overwrite").parquet(args.flagged)
    return 0 if row.ok else 1


def _train(spark, args) -> int:
    tables = load_tables(spark, args.tables, with_label=args.kind == "fraud")
    if args.kind == "fraud":
        rows, features, label, key = fraud_features_training(tables), FRAUD_FEATURES, FRAUD_LABEL, "order_id"
    else:
        rows, features, label, key = late_delivery_features(tables), LATE_FEATURES, LATE_LABEL, "shipment_id"
    quality = train_and_store(
        rows, features, label, key, args.model, f"{args.kind}_detection_pipeline", args.run_ts,
        training_data=args.tables).first()
    print(f"accuracy={quality.accuracy:.4f} f1={quality.f1:.4f} roc_auc={quality.roc_auc:.4f}")
    return 0


def _intake(spark, args) -> int:
    intake_stream(
        spark, args.requests, load_tables(spark, args.tables), args.out, args.checkpoint).awaitTermination()
    return 0


def main(argv: Sequence[str] | None = None) -> int:
    now = datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")
    parser = argparse.ArgumentParser(prog="packhouse.jobs")
    jobs = parser.add_subparsers(required=True)

    score = jobs.add_parser("score", help="score open orders and commit the predictions")
    score.add_argument("--store", required=True, help="folder of the versioned predictions")
    score.add_argument("--model", help="folder written by train; without it the hash scorer runs")
    score.add_argument("--scorer", choices=["mock", "python"])
    score.add_argument("--flagged", help="folder for the flagged open orders")
    score.set_defaults(job=_score)

    train = jobs.add_parser("train", help="train, evaluate and store a model")
    train.add_argument("--kind", choices=["fraud", "late_delivery"], default="fraud")
    train.add_argument("--model", required=True)
    train.set_defaults(job=_train)

    intake = jobs.add_parser("intake", help="apply the request files that arrived")
    for name in ("--requests", "--out", "--checkpoint"):
        intake.add_argument(name, required=True)
    intake.set_defaults(job=_intake)

    for job in (score, train, intake):
        job.add_argument("--tables", required=True, help="folder of the operational tables")
        job.add_argument("--run-ts", default=now, help="time of the run, UTC; repeat it to repeat a run")

    args = parser.parse_args(argv)
    return args.job(build_session("packhouse-job"), args)


if __name__ == "__main__":
    raise SystemExit(main())
