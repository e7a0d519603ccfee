"""Cross-validation folds from exact row numbers that no single task computes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.plans.roles import col
from tabweave.session import materialize

ROWS_PER_RANGE = 1_000_000


def _in_ranges(df: DataFrame, order: str, ranges: int | None) -> DataFrame:
    """The rows with ``__range``, a number that grows with the order column, as a stored table.

    Spark samples the limits of the ranges, so they may differ when a plan is run again; the table
    fixes them for the counts and the numbering that follow.
    """
    if ranges is None:
        cores = df.sparkSession.sparkContext.defaultParallelism
        ranges = max(cores, math.ceil(df.count() / ROWS_PER_RANGE))
    parts = df.repartitionByRange(ranges, col(order)).select("*", F.spark_partition_id().alias("__range"))
    return materialize(parts, "row-ranges")


def numbered(df: DataFrame, order: str, by: str | None = None, ranges: int | None = None) -> DataFrame:
    """Add ``__row``, the 1-based row number by a unique id, within each value of ``by``, and ``__rows``.

    Ids are cut in ranges of about a million rows; rows are numbered inside a range and shifted
    by the rows of the ranges before it, so even one label on every row is spread over the ranges.
    """
    label = F.lit(0) if by is None else col(by)
    data = _in_ranges(df, order, ranges).withColumn("__label", label)
    # few rows: one per label and range
    counts = data.groupBy("__label", "__range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("__label").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("__label")
    offsets = counts.select(
        F.col("__label").alias("__l"),
        F.col("__range").alias("__r"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__skip"),
        F.sum("n").over(whole).alias("__rows"),
    )
    inside = Window.partitionBy("__label", "__range").orderBy(col(order))
    local = data.select("*", F.row_number().over(inside).alias("__local"))
    joined = local.join(offsets, F.col("__label").eqNullSafe(F.col("__l")) & (F.col("__range") == F.col("__r")))
    return joined.select(
        *[col(c) for c in df.columns], (F.col("__local") + F.col("__skip")).alias("__row"), "__rows"
    )


def block_number(row: Column, rows: Column, folds: int) -> Column:
    """0-based block of a row when ``rows`` rows are cut in equal blocks, longer ones first."""
    short = F.floor(rows / folds)
    long_blocks = rows % folds
    edge = long_blocks * (short + 1)
    at = row - 1
    return F.when(at < edge, F.floor(at / (short + 1))).otherwise(
        long_blocks + F.floor((at - edge) / F.greatest(short, F.lit(1)))
    )


def add_folds(df: DataFrame, order: str, folds: int, label: str | None = None, output: str = "fold") -> DataFrame:
    """Fold per row: dealt out within each label for classifiers, equal blocks for regressors."""
    if folds < 2:
        raise ValueError("at least 2 folds are needed")
    data = numbered(df, order, label)
    if label is not None:
        fold = F.pmod(F.col("__row") - 1, F.lit(folds))
    else:
        fold = block_number(F.col("__row"), F.col("__rows"), folds)
    return data.select(*[col(c) for c in df.columns], fold.cast("int").alias(output))
