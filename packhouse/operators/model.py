"""Training, storing and applying the weighted logistic regression."""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packhouse.functions.scalars import as_number
from packhouse.operators.features import Tables, late_delivery_features
from packhouse.operators.metrics import binary_metrics, classification_report
from packhouse.operators.quantiles import exact_quantiles
from packhouse.operators.split import stratified_split
from packhouse.schemas import LATE_FEATURES, LATE_LABEL
from packhouse.sources.shared import materialize

#: Newton steps, each one pass over the rows, and the largest change of a coefficient that ends them.
MAX_PASSES = 50
TOLERANCE = 1e-10
THRESHOLD = 0.5
MODEL_VERSION = "1.0.0"


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    return {c: (q[0] if q[0] is not None else 0.0) for c, q in exact_quantiles(df, columns, [0.5]).items()}


def median_impute(df: DataFrame, columns: Sequence[str], fitted: Mapping[str, float]) -> DataFrame:
    """Put the fitted medians where a value is missing: null, NaN or no number."""
    return df.withColumns({c: F.coalesce(as_number(c), F.lit(fitted[c])) for c in columns})


def scale_parameters(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation; a constant column is divided by 1."""
    row = df.agg(*[
        part for i, c in enumerate(columns)
        for part in (F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"))]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def standard_scale(df: DataFrame, columns: Sequence[str],
                   fitted: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - fitted[c][0]) / fitted[c][1] for c in columns})


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Append `weight` = n / (classes * rows of the class). One row per class is broadcast."""
    per_class = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_rows"))
    totals = per_class.agg(F.struct(F.sum("_rows").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    weights = per_class.select(
        label, (totals.getField("n") / (totals.getField("k") * F.col("_rows"))).alias("weight"))
    return df.join(F.broadcast(weights), label).select(*df.columns, "weight")


def _literal(value: float) -> str:
    if not math.isfinite(value):
        raise ValueError(f"a fitted parameter is not finite: {value}")
    return f"cast({value!r} as double)"


def newton(rows: DataFrame, features: Sequence[str], label: str, weights: Mapping[int, float]) -> tuple[list[float], float]:
    """Coefficients and intercept that minimise the weighted log loss plus half the squared length of the coefficients.

    Each step is one pass that adds up loss, gradient and curvature, (d + 1) (d + 4) / 2 + 1 numbers, which the driver solves. A step
    that does not lower the loss is halved. The loss is strictly convex, so few steps are needed, whatever the rows.
    """
    x = [*(F.col(c) for c in features), F.lit(1.0)]
    weight = F.coalesce(*[F.when(F.col(label) == k, F.lit(float(w))) for k, w in weights.items()])
    penalty = np.diag([1.0] * len(features) + [0.0])
    pairs = [(i, j) for i in range(len(x)) for j in range(i + 1)]

    def sums(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        margin = sum((F.lit(float(b)) * c for b, c in zip(beta, x)), F.lit(0.0))
        given = rows.select(*features, label, weight.alias("_w"), margin.alias("_m"))
        given = given.select("*", (1 / (1 + F.exp(-F.col("_m")))).alias("_p"))
        given = given.select("*", (F.col("_w") * (F.col("_p") - F.col(label))).alias("_g"),
                             (F.col("_w") * F.col("_p") * (1 - F.col("_p"))).alias("_c"))
        # log(1 + exp(m)) without overflow
        loss = F.col("_w") * (F.greatest("_m", F.lit(0.0)) + F.log1p(F.exp(-F.abs("_m"))) - F.col(label) * F.col("_m"))
        row = given.agg(F.sum(loss), *[F.sum(F.col("_g") * c) for c in x], *[F.sum(F.col("_c") * x[i] * x[j]) for i, j in pairs]).first()
        curvature = np.zeros((len(x), len(x)))
        for (i, j), value in zip(pairs, row[1 + len(x):]):
            curvature[i, j] = curvature[j, i] = value
        return row[0] + beta @ penalty @ beta / 2, np.array(row[1:1 + len(x)]) + penalty @ beta, curvature + penalty

    beta = np.zeros(len(x))
    loss, gradient, curvature = sums(beta)
    step = np.linalg.solve(curvature, -gradient)
    for _ in range(MAX_PASSES):
        if np.abs(step).max() <= TOLERANCE * max(1.0, np.abs(beta).max()):
            break
        found = sums(beta + step)
        if not found[0] <= loss * (1 + 1e-14):
            step = step / 2
            continue
        beta = beta + step
        loss, gradient, curvature = found
        step = np.linalg.solve(curvature, -gradient)
    return beta[:-1].tolist(), float(beta[-1])


def _regression(spark: SparkSession, coefficients: Sequence[float], intercept: float) -> LogisticRegressionModel:
    """A model of Spark's with given numbers."""
    jvm = spark._jvm
    values = spark.sparkContext._gateway.new_array(jvm.double, len(coefficients))
    for i, c in enumerate(coefficients):
        values[i] = float(c)
    made = LogisticRegressionModel(jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        f"newton_{uuid.uuid4().hex[:12]}", jvm.org.apache.spark.ml.linalg.Vectors.dense(values), float(intercept)))
    return (made.setFeaturesCol("_features").setProbabilityCol("_probability").setRawPredictionCol("_raw")
            .setPredictionCol("_prediction"))


def fit_logistic(train: DataFrame, features: Sequence[str], label: str) -> PipelineModel:
    """Median imputation, standardisation and an L2 logistic regression with balanced classes.

    The penalty is that of C = 1 with an unpenalised intercept, over balanced weights, which add up to n. With rows of one
    class only, every row gets that class for certain. Reads `train` a few times and writes the prepared rows once: pass
    stored rows, as `stratified_split` returns them.
    """
    spark = train.sparkSession
    rows = train.select(
        *[as_number(c).alias(c) for c in features], F.col(label).cast("int").alias(label)
    ).where(F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # one row per class
    if not counts:
        raise ValueError("no training rows")
    middle = medians(rows, features)
    scale = scale_parameters(median_impute(rows, features, middle), features)
    prepared = ", ".join(
        f"(coalesce(nanvl(try_cast(`{c}` as double), cast(null as double)), {_literal(middle[c])}) - {_literal(scale[c][0])})"
        f" / {_literal(scale[c][1])} as `_z_{c}`" for c in features)
    prepare = SQLTransformer(statement=f"select *, {prepared} from __THIS__")
    scaled = [f"_z_{c}" for c in features]
    assemble = VectorAssembler(inputCols=scaled, outputCol="_features")
    if len(counts) == 1:
        fitted = [0.0] * len(features), math.inf if 1 in counts else -math.inf
    else:
        n = sum(counts.values())
        ready = materialize(prepare.transform(rows).select(*scaled, label), "prepared")
        fitted = newton(ready, scaled, label, {k: n / (len(counts) * c) for k, c in counts.items()})
    return PipelineModel([prepare, assemble, _regression(spark, *fitted)])


def predict(model: PipelineModel, df: DataFrame, threshold: float = THRESHOLD, strict: bool = False) -> DataFrame:
    """Append `prob` (class 1) and `pred`.

    Serving flags prob >= threshold; `strict` uses prob > threshold, as the evaluation does.
    """
    scored = model.transform(df).withColumn("prob", vector_to_array("_probability")[1])
    cut = F.col("prob") > threshold if strict else F.col("prob") >= threshold
    return scored.select(*df.columns, "prob", cut.cast("int").alias("pred"))


@dataclass(frozen=True)
class LinearParameters:
    """A fitted pipeline as plain numbers, for scoring with one SQL expression."""

    features: tuple[str, ...]
    medians: tuple[float, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]
    coefficients: tuple[float, ...]
    intercept: float


def predict_linear(parameters: LinearParameters, df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    margin = F.lit(parameters.intercept)
    for name, median, mean, deviation, weight in zip(
            parameters.features, parameters.medians, parameters.means, parameters.deviations,
            parameters.coefficients, strict=True):
        value = F.coalesce(as_number(name), F.lit(median))
        margin = margin + F.lit(weight) * ((value - F.lit(mean)) / F.lit(deviation))
    scored = df.withColumn("prob", 1 / (1 + F.exp(-margin)))
    return scored.withColumn("pred", (F.col("prob") >= threshold).cast("int"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_smoke_check(path: str, df: DataFrame, key: str = "order_id") -> DataFrame:
    """Reload a stored model and score the three rows with the smallest keys."""
    scored = predict(load_model(path), df.orderBy(key).limit(3))
    return scored.select(key, F.round("prob", 4).alias("prob"))


def write_model_card(spark: SparkSession, meta: DataFrame, metrics: DataFrame, path: str) -> None:
    """Store the one-row metadata and metrics tables as JSON under `path`."""
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")


def load_features(spark: SparkSession, path: str) -> list[str]:
    """The ordered feature names of a stored card; an error if there are none."""
    card = spark.read.json(f"{path}/metadata")
    row = card.first()
    names = row["features"] if row is not None and "features" in card.columns else None
    if not isinstance(names, list) or not names:
        raise ValueError("the model card has no non-empty 'features' array")
    return [str(n) for n in names]


def require_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The feature columns as numbers (null where they are none) beside the other columns."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"Missing feature columns after ETL: {missing}")
    return df.withColumns({c: as_number(c) for c in features})


def train_and_store(rows: DataFrame, features: Sequence[str], label: str, key: str, path: str, name: str,
                    trained_at: str, seed: int = 42, training_data: str = "") -> DataFrame:
    """Split, fit, evaluate on the hold-out rows, and store model and card under `path`; `training_data` says in the card where
    the rows come from.

    Returns the one-row metrics table that the card holds.
    """
    spark = rows.sparkSession
    rows = materialize(rows.select(key, *features, label), "training")
    train, test = stratified_split(rows, label, key, seed=seed)
    fitted = fit_logistic(train, features, label)
    scored = materialize(predict(fitted, test, strict=True).select(label, "prob", "pred"), "scored")
    entry = F.struct("class", F.struct("precision", "recall", "f1", "support"))
    # The report has five rows.
    report = classification_report(scored, label).agg(F.map_from_entries(F.collect_list(entry)))
    quality = binary_metrics(scored, label).withColumn("classification_report", report.scalar())
    meta = spark.createDataFrame(
        [(name, MODEL_VERSION, trained_at, training_data, train.count(), test.count(), list(features), label)],
        "model_name string, model_version string, trained_at_utc string, training_data string, num_training_rows long,"
        " num_test_rows long, features array<string>, label string")
    save_model(fitted, f"{path}/model")
    write_model_card(spark, meta, quality, path)
    return quality


def late_delivery_evaluate(tables: Tables, seed: int = 42) -> DataFrame:
    """Train the late-delivery model and report on its hold-out rows."""
    rows = materialize(late_delivery_features(tables), "late-features")
    train, test = stratified_split(rows, LATE_LABEL, "shipment_id", seed=seed)
    model = fit_logistic(train, LATE_FEATURES, LATE_LABEL)
    return classification_report(predict(model, test, strict=True), LATE_LABEL, "pred")
