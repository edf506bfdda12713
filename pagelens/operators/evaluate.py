"""Score predictions against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.urls import normalise_url
from pagelens.operators.model import UNCATEGORIZED


def _label_counts(frame: DataFrame, label: str, count: str) -> DataFrame:
    """Rows per URL and label. Combining first means no URL is hot in the join."""
    return (
        frame.select(
            normalise_url(F.col("url")).alias("url"),
            F.coalesce(F.nullif("category", F.lit("")), F.lit(UNCATEGORIZED)).alias(label),
        )
        .groupBy("url", label)
        .agg(F.count(F.lit(1)).alias(count))
    )


def confusion(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Matched rows per true and predicted label: ``(true_label, pred_label, n)``.

    URLs match after normalising. Repeats multiply, so the counts are multiplied
    and the pairs never built. URLs on one side only drop out; missing URLs match
    each other; a missing label is Uncategorized.
    """
    pred = _label_counts(predictions, "pred_label", "n_pred")
    true = _label_counts(labels, "true_label", "n_true").withColumnRenamed("url", "true_url")
    matched = pred.join(true, pred["url"].eqNullSafe(true["true_url"]))
    return matched.groupBy("true_label", "pred_label").agg(
        F.sum(F.col("n_pred") * F.col("n_true")).alias("n")
    )


def _ratio(numerator: Column, denominator: Column) -> Column:
    """Zero when undefined."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(
        numerator / F.when(denominator != 0, denominator)
    )


def class_scores(matrix: DataFrame) -> DataFrame:
    """Unrounded precision, recall, F1 and support per label of either side.

    Reads the confusion counts once: each cell counts towards its true label and
    its predicted label.
    """
    hit = F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(
            F.col("true_label").alias("label"),
            hit.alias("tp"),
            F.col("n").alias("support"),
            zero.alias("predicted"),
        ),
        F.struct(
            F.col("pred_label").alias("label"),
            zero.alias("tp"),
            zero.alias("support"),
            F.col("n").alias("predicted"),
        ),
    )
    totals = (
        matrix.select(F.inline(sides))
        .groupBy("label")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    )
    return totals.select(
        "label",
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
        "tp",
    )


def _rounded(column: str) -> Column:
    return F.bround(F.col(column), 4)


def per_class(matrix: DataFrame) -> DataFrame:
    """Scores per label to four places."""
    return class_scores(matrix).select(
        "label", *[_rounded(c).alias(c) for c in ("precision", "recall", "f1")], "support"
    )


def overall(matrix: DataFrame) -> DataFrame:
    """One row of matched URLs, accuracy and macro means; none without a match."""
    means = {"macro_precision": "precision", "macro_recall": "recall", "macro_f1": "f1"}
    return (
        class_scores(matrix)
        .agg(
            F.sum("support").alias("matched_urls"),
            (F.sum("tp") / F.sum("support")).alias("accuracy"),
            *[F.avg(source).alias(name) for name, source in means.items()],
        )
        .filter("matched_urls is not null")
        .select("matched_urls", *[_rounded(c).alias(c) for c in ("accuracy", *means)])
    )


def report_rows(matrix: DataFrame) -> DataFrame:
    """Per-class rows for printing: percentages to one place, by label."""
    scores = class_scores(matrix)
    percents = [
        F.bround(F.col(c) * 100, 1).alias(f"{c}_pct") for c in ("precision", "recall", "f1")
    ]
    return scores.select("label", *percents, F.col("support").alias("n")).orderBy("label")
