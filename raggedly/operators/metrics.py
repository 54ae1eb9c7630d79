"""Classifier metrics from stored logits and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import float_bucket
from ..functions.scoring import argmax, cross_entropy, softmax
from ..session import stored
from .prefix import running


def scored(predictions: DataFrame) -> DataFrame:
    """(label, logits) -> label, prediction and float32 class probabilities.

    Rows without logits are left out. Scores are float32, as a network emits them;
    that also bounds how many distinct scores there can be.
    """
    return predictions.where(F.col("logits").isNotNull()).select(
        F.col("label").cast("int").alias("label"),
        argmax(F.col("logits")).alias("prediction"),
        softmax(F.col("logits")).cast("array<float>").alias("probs"),
    )


def mean_loss(predictions: DataFrame) -> DataFrame:
    return predictions.where(F.col("logits").isNotNull()).agg(
        F.avg(cross_entropy(F.col("logits"), F.col("label"))).alias("loss"),
        F.count("*").alias("n"),
    )


def accuracy(scored_rows: DataFrame) -> DataFrame:
    return scored_rows.agg(
        F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"),
        F.count("*").alias("n"),
    )


def confusion(scored_rows: DataFrame) -> DataFrame:
    return scored_rows.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def class_f1(scored_rows: DataFrame) -> DataFrame:
    """F1 per class that occurs as a label or as a prediction."""
    return f1_of(confusion(scored_rows))


def f1_of(cells: DataFrame) -> DataFrame:
    """``class_f1`` from the cells of a confusion matrix."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = cells.select(
        hit.alias("hit"),
        F.explode(F.array(F.col("label"), F.col("prediction"))).alias("class"),
        "n",
    )
    # Each cell counts once for its label and once for its prediction, so the sum of
    # both sides is 2 tp + fp + fn, and hits are counted twice.
    return sides.groupBy("class").agg((F.sum("hit") / F.sum("n").cast("double")).alias("f1"))


def macro_f1(scored_rows: DataFrame) -> DataFrame:
    return class_f1(scored_rows).agg(F.avg("f1").alias("macro_f1"))


def score_counts(scored_rows: DataFrame) -> DataFrame:
    """One-versus-rest positives and negatives per class and distinct score."""
    rows = scored_rows.select("label", F.posexplode_outer("probs").alias("class", "score"))
    positive = (F.col("label") == F.col("class")).cast("long")
    return rows.groupBy("class", "score").agg(
        F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg")
    )


def auroc(scored_rows: DataFrame, empty: float | None = None) -> DataFrame:
    """Area under the ROC curve per class; ties count half.

    A class without positives or without negatives gives ``empty``.
    """
    return auroc_of(score_counts(scored_rows), empty)


def auroc_of(counts: DataFrame, empty: float | None = None) -> DataFrame:
    """``auroc`` from ``score_counts``."""
    below = running(
        counts, ["class"], ["score"], float_bucket(F.col("score")),
        sums={"upto": F.col("neg")},
    )
    pairs = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / F.lit(2.0)))
    total = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return below.groupBy("class").agg(
        F.when(total > 0, pairs / total).otherwise(F.lit(empty).cast("double")).alias("auroc")
    )


def mean_auroc(scored_rows: DataFrame, empty: float | None = None) -> DataFrame:
    return auroc(scored_rows, empty).agg(F.avg("auroc").alias("mean_auroc"))


def roc(scored_rows: DataFrame) -> DataFrame:
    """ROC points per class by falling threshold, without the (0, 0) start.

    A class without positives (negatives) has a null TPR (FPR).
    """
    return roc_of(score_counts(scored_rows))


def roc_of(counts: DataFrame) -> DataFrame:
    """``roc`` from ``score_counts``."""
    curve = running(
        counts, ["class"], [F.col("score").desc()],
        float_bucket(-F.col("score")),
        sums={"tp": F.col("pos"), "fp": F.col("neg")}, totals=True,
    )
    return curve.select(
        "class",
        F.col("score").alias("threshold"),
        F.try_divide(F.col("fp").cast("double"), F.col("fp_total")).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.col("tp_total")).alias("tpr"),
    )


def with_start(curve: DataFrame) -> DataFrame:
    """Add the (0, 0) point, at threshold 1, that every curve starts from."""
    start = curve.select("class").distinct().select(
        "class",
        F.lit(1.0).cast("float").alias("threshold"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return start.unionByName(curve)


def tpr_at_fpr(
    curve: DataFrame, target: float = 0.01, by: Sequence[str] = ("class",)
) -> DataFrame:
    """TPR at a false-positive rate, linear between the neighbouring ROC points.

    ``curve`` may lack the start point: no point at or below the target means (0, 0).
    """
    point = F.struct("fpr", "tpr")
    ends = curve.groupBy(*by).agg(
        F.max(F.when(F.col("fpr") <= target, point)).alias("lo"),
        F.min(F.when(F.col("fpr") > target, point)).alias("hi"),
    )
    lo_f, lo_t = F.coalesce("lo.fpr", F.lit(0.0)), F.coalesce("lo.tpr", F.lit(0.0))
    rise = (F.col("hi.tpr") - lo_t) / (F.col("hi.fpr") - lo_f) * (target - lo_f)
    return ends.select(*by, (lo_t + F.coalesce(rise, F.lit(0.0))).alias("tpr"))


def macro_tpr_at_fpr(curve: DataFrame, target: float = 0.01) -> DataFrame:
    return tpr_at_fpr(curve, target).agg(F.avg("tpr").alias("macro_tpr"))


def named(per_class: DataFrame, class_names: Sequence[str]) -> DataFrame:
    """Add the class name; the names are a declared list."""
    return per_class.withColumn(
        "class_name", F.get(F.lit(list(class_names)), F.col("class").cast("int"))
    )


def metric(metrics: DataFrame, name: str, column: str = "name") -> Column | float:
    """Value of one named metric; an error if there is none."""
    rows = metrics.where(F.col(column) == name).limit(1).collect()
    if not rows:
        raise KeyError(f"metric '{name}' was not computed")
    return rows[0]["value"]


class Evaluator:
    """All metrics of one prediction table, each as a DataFrame."""

    def __init__(self, predictions: DataFrame, class_names: Sequence[str]):
        self.predictions = predictions
        self.class_names = list(class_names)
        self.scored = scored(predictions)

    def summary(self, target_fpr: float = 0.01) -> DataFrame:
        """(name, value) of every scalar metric, from two passes over the predictions.

        One pass counts classes and scores, one counts labels and predictions with their
        losses; both results are stored, and everything else is made from them.
        """
        counts = stored(score_counts(self.scored), "score-counts")
        rows = self.predictions.where(F.col("logits").isNotNull()).select(
            F.col("label").cast("int").alias("label"),
            argmax(F.col("logits")).alias("prediction"),
            cross_entropy(F.col("logits"), F.col("label")).alias("loss"),
        )
        cells = stored(
            rows.groupBy("label", "prediction").agg(
                F.count("*").alias("n"), F.sum("loss").alias("loss"), F.count("loss").alias("n_loss")
            ),
            "cells",
        )
        areas = stored(auroc_of(counts), "areas")
        hits = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
        value = {
            "loss": cells.agg((F.sum("loss") / F.sum("n_loss")).alias("value")),
            "acc": cells.agg((hits / F.sum("n")).alias("value")),
            "f1": f1_of(cells).agg(F.avg("f1").alias("value")),
            "mean_auc": areas.agg(F.avg("auroc").alias("value")),
            "tpr_macro": tpr_at_fpr(roc_of(counts), target_fpr).agg(F.avg("tpr").alias("value")),
        }
        out = named(areas, self.class_names).select(
            F.concat(F.lit("class_"), "class_name", F.lit("_auc")).alias("name"),
            F.col("auroc").alias("value"),
        )
        for name, row in value.items():
            out = out.unionByName(row.select(F.lit(name).alias("name"), "value"))
        return out
