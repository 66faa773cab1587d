"""Model metrics as single-pass aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.operators.ranking import running_totals


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def classification_metrics(df: DataFrame, label: str = "label", predicted: str = "prediction",
                           by: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall and F1; a zero denominator gives 0."""
    y, p = F.col(label), F.col(predicted)
    counts = df.groupBy(*(by or [])).agg(
        F.count_if((y == 1) & (p == 1)).cast("double").alias("tp"),
        F.count_if((y == 0) & (p == 1)).cast("double").alias("fp"),
        F.count_if((y == 1) & (p == 0)).cast("double").alias("fn"),
        F.count_if((y == 0) & (p == 0)).cast("double").alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *(by or []),
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "probability") -> DataFrame:
    """Area under the ROC curve, ties counted half; null unless both classes occur.

    Rows shrink to one per distinct score, then negatives below each score come from running totals.
    """
    y = F.col(label)
    per_score = df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    ranked = running_totals(per_score, "score", ["neg"])
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return ranked.agg(F.try_divide(won, pairs).alias("roc_auc"))


def regression_metrics(df: DataFrame, label: str = "label", predicted: str = "prediction",
                       by: list[str] | None = None) -> DataFrame:
    """Mean squared error and R squared, from one aggregate (``var_pop`` is the spread of the label)."""
    y, p = F.col(label).cast("double"), F.col(predicted)
    mse = F.avg((y - p) * (y - p))
    return df.filter(y.isNotNull()).groupBy(*(by or [])).agg(
        mse.alias("mse"), (1 - F.try_divide(mse, F.var_pop(y))).alias("r2_score"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights: rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("rows"), F.count("*").alias("classes"))).scalar()
    return counts.withColumn("_t", totals).select(
        label, (F.col("_t.rows") / (F.col("_t.classes") * F.col("n"))).alias("weight"))
