"""Evaluation of predicted boxes against the truth: accuracy at a threshold, mean overlap, failures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import iou, is_hit, valid_box


def scored(truth: DataFrame, predictions: DataFrame, key: str = "key") -> DataFrame:
    """(key, truth, prediction, iou, failed): each item of the truth with its prediction, or null; other predictions are ignored.

    The item's side is kept whole; Spark broadcasts the predictions if they are small and splits skewed keys if not.
    """
    t = truth.select(key, F.col("bbox").alias("truth"))
    p = predictions.select(key, F.col("bbox").alias("prediction"))
    x = t.join(p, key, "left")
    return x.select("*", iou(F.col("truth"), F.col("prediction")).alias("iou"), valid_box(F.col("prediction")).isNull().alias("failed"))


def evaluate(truth: DataFrame, predictions: DataFrame, key: str = "key", threshold: float = 0.5) -> DataFrame:
    """One row: hits, total, acc_at_threshold, mean_iou, failures; all null without items. A truth that is no valid box raises.

    Failures count as overlap 0 in the mean. Overlaps are summed as decimals, so the sum does not depend on their order.
    """
    x = scored(truth, predictions, key)
    checked = F.when(valid_box(F.col("truth")).isNull(), F.raise_error(F.concat(F.lit("invalid truth: "), F.col(key).cast("string")))).otherwise(F.col("iou"))
    x = x.withColumn("iou", checked.cast("double"))
    total = F.count("*")
    out = x.agg(
        F.count_if(is_hit(F.col("iou"), threshold)).alias("hits"), total.alias("total"),
        F.sum(F.col("iou").cast("decimal(18,9)")).cast("double").alias("overlap"), F.count_if("failed").alias("failures"),
    )
    some = F.col("total") > 0
    null = lambda c: F.when(some, c)
    return out.select(null(F.col("hits")).alias("hits"), null(F.col("total")).alias("total"), null(F.col("hits") / F.col("total")).alias("acc_at_threshold"), null(F.col("overlap") / F.col("total")).alias("mean_iou"), null(F.col("failures")).alias("failures"))


def evaluate_trainable(dataset: DataFrame, predictions: DataFrame, key: str = "key") -> DataFrame:
    """``evaluate`` over the items that have a query and a valid box."""
    return evaluate(dataset.where((F.col("query") != "") & valid_box(F.col("bbox")).isNotNull()), predictions, key)


def valid_predictions(predictions: DataFrame) -> DataFrame:
    """One row: how many predictions there are, and how many are valid boxes."""
    return predictions.agg(F.count("*").alias("predictions"), F.count_if(valid_box(F.col("bbox")).isNotNull()).alias("valid"))
