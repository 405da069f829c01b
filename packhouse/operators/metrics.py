"""Quality of binary predictions."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(numerator: Column, denominator: Column) -> Column:
    """0 where undefined."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / denominator)


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """tp, fp, fn, tn in one row."""
    truth, guess = F.col(label) == 1, F.col(pred) == 1
    return df.agg(
        F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"),
        F.count_if(truth & ~guess).alias("fn"), F.count_if(~truth & ~guess).alias("tn"))


def roc_auc(df: DataFrame, label: str, prob: str) -> float:
    """Exact area: the curve has a point for every distinct probability."""
    return BinaryClassificationEvaluator(
        rawPredictionCol=prob, labelCol=label, metricName="areaUnderROC", numBins=0
    ).evaluate(df.select(F.col(label).cast("double").alias(label), F.col(prob).cast("double").alias(prob)))


def binary_metrics(df: DataFrame, label: str = "label", prob: str = "prob", pred: str = "pred") -> DataFrame:
    """accuracy, f1 of class 1 and ROC AUC in one row. Reads `df` twice."""
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return confusion(df, label, pred).select(
        F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.lit(roc_auc(df, label, prob)).alias("roc_auc"))


def _scores(name: str, hit: Column, guessed: Column, actual: Column) -> Column:
    return F.struct(
        F.lit(name).alias("class"), _ratio(hit, guessed).alias("precision"), _ratio(hit, actual).alias("recall"),
        _ratio(2 * hit, guessed + actual).alias("f1"), actual.cast("bigint").alias("support"))


def classification_report(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and support-weighted averages.

    The accuracy row has the accuracy in all three score columns.
    """
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    classes = confusion(df, label, pred).select(
        total.alias("n"), F.try_divide(tp + tn, total).alias("accuracy"),
        _scores("0", tn, tn + fn, tn + fp).alias("c0"), _scores("1", tp, tp + fp, tp + fn).alias("c1"))
    measures = ("precision", "recall", "f1")
    c0, c1, n = F.col("c0"), F.col("c1"), F.col("n")

    def row(name: str, value) -> Column:
        return F.struct(F.lit(name).alias("class"), *[value(m).alias(m) for m in measures], n.alias("support"))

    return classes.select(F.inline(F.array(
        c0, c1,
        row("accuracy", lambda m: F.col("accuracy")),
        row("macro avg", lambda m: (c0[m] + c1[m]) / 2),
        row("weighted avg", lambda m: F.try_divide(c0[m] * c0["support"] + c1[m] * c1["support"], n)),
    )))
