"""Standard and min-max scaling as plain projections."""

from __future__ import annotations

import math

from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.operators.selection import assemble
from tabweave.plans.roles import col


def fit_scale(df: DataFrame, columns: list[str], kind: str) -> dict:
    """Offset and divisor per column: mean and population deviation, or minimum and range.

    A constant column gets the divisor 1, so it becomes 0.
    """
    if kind not in ("standard", "minmax"):
        raise ValueError(f"unknown scaler '{kind}'")
    scales: dict[str, list[float]] = {}
    if columns:
        stats = Summarizer.metrics("count", "mean", "variance", "min", "max")
        row = assemble(df, columns).agg(stats.summary(F.col("features")).alias("s")).first()["s"]
        n = row["count"]
        for i, c in enumerate(columns):
            if kind == "standard":
                shift = float(row["mean"][i])
                spread = math.sqrt(row["variance"][i] * (n - 1) / n) if n > 1 else 0.0
            else:
                shift = float(row["min"][i])
                spread = float(row["max"][i]) - shift
            constant = row["min"][i] == row["max"][i]
            scales[c] = [float(row["min"][i]) if constant else shift, 1.0 if constant or not spread else spread]
    return {"op": "scale", "kind": kind, "scales": scales}


def apply_scale(df: DataFrame, spec: dict) -> DataFrame:
    scales = spec["scales"]
    out = []
    for c in df.columns:
        if c in scales:
            shift, spread = scales[c]
            out.append(((col(c).cast("double") - shift) / spread).alias(c))
        else:
            out.append(col(c))
    return df.select(*out)
