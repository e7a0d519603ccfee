"""Evaluation as aggregates over labels and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.plans.roles import col


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Row counts per pair of label and prediction; the only pass over the data."""
    pairs = df.select(col(label).alias("label"), col(prediction).alias("prediction"))
    return pairs.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Share of labelled rows that are right; rows without a label don't count."""
    return df.where(col(label).isNotNull()).agg(F.avg((col(label) == col(prediction)).cast("double")).alias("accuracy"))


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted means.

    Rows without a label don't count. The rest are read once, for the confusion counts; what follows is over at
    most classes x classes rows, and both parts of the report share that shuffle.
    """
    n, none = F.col("n"), F.lit(0).cast("long")
    hit = F.when(F.col("label") == F.col("prediction"), n).otherwise(none)
    sides = confusion(df.where(col(label).isNotNull()), label, prediction).select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("class"), n.alias("support"), none.alias("predicted"), hit.alias("hit")),
                F.struct(F.col("prediction").alias("class"), none.alias("support"), n.alias("predicted"), none.alias("hit")),
            )
        )
    )
    classes = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hit")])
    scored = classes.select(
        F.col("class").cast("string").alias("class"),
        _ratio(F.col("hit"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hit"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hit"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
        "hit",
    )
    measures = ["precision", "recall", "f1"]
    means = scored.agg(
        F.sum("support").alias("support"),
        F.sum("hit").alias("hit"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[_ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}") for m in measures],
    )

    def line(name: str, values: list) -> Column:
        return F.struct(F.lit(name).alias("class"), *[v.alias(m) for v, m in zip(values, measures)], F.col("support"))

    summary = F.array(
        line("accuracy", [_ratio(F.col("hit"), F.col("support"))] * 3),
        line("macro avg", [F.col(f"macro_{m}") for m in measures]),
        line("weighted avg", [F.col(f"weighted_{m}") for m in measures]),
    )
    return scored.select("class", *measures, "support").unionByName(means.select(F.inline(summary)))


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Mean squared error and R^2 in one pass; the total spread is a variance, not a difference of sums."""
    y, guess = col(label).cast("double"), col(prediction).cast("double")
    error = (y - guess) * (y - guess)
    row = df.where(y.isNotNull()).agg(
        F.avg(error).alias("mse"), F.sum(error).alias("sse"), (F.var_pop(y) * F.count(y)).alias("sst")
    )
    r2 = F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).otherwise(
        F.when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    )
    return row.select("mse", r2.alias("r2"))


def target_summary(df: DataFrame, target: str, task: str) -> DataFrame:
    """Rows per class, or the range of a numeric target."""
    if task == "classification":
        return df.groupBy(col(target).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return df.agg(F.min(col(target)).alias("low"), F.max(col(target)).alias("high"))
