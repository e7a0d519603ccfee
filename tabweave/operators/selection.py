"""Correlation pruning and K-best selection."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabweave.operators import gram
from tabweave.plans.roles import col

CORRELATION_LIMIT = 0.95
SELECT_ABOVE = 30
KEEP_SHARE = 0.8
KEEP_AT_LEAST = 30


def assemble(df: DataFrame, columns: list[str], others: list[str] = (), output: str = "features") -> DataFrame:
    """The columns as one double vector, next to some other columns."""
    doubles = [col(c).cast("double").alias(f"__f{i}") for i, c in enumerate(columns)]
    flat = df.select(*[col(c) for c in others], *doubles)
    made = VectorAssembler(
        inputCols=[f"__f{i}" for i in range(len(columns))], outputCol=output, handleInvalid="keep"
    ).transform(flat)
    return made.select(*[col(c) for c in others], output)


def fit_correlation_prune(df: DataFrame, columns: list[str], limit: float = CORRELATION_LIMIT, block: int = gram.BLOCK) -> list[str]:
    """Columns correlated above the limit with any earlier one, kept or not.

    Correlations are a table of blocks; only the names found are read.
    """
    if len(columns) < 2:
        return []
    return gram.Gram(df, columns, block).strong_columns(limit)


def anova_scores(df: DataFrame, columns: list[str], target: str) -> dict[str, float]:
    """ANOVA F of each column over the target's classes, from per-class means and variances.

    One pass makes a summary per class; these are combined per column on the executors, so the
    driver reads one number per column however many classes there are.
    """
    data = assemble(df.where(col(target).isNotNull()), columns, [target])
    stats = Summarizer.metrics("mean", "variance", "count")
    classes = data.groupBy(col(target).alias("y")).agg(stats.summary(F.col("features")).alias("s"))
    cells = classes.select(
        F.col("s.count").cast("double").alias("n"),
        F.posexplode(F.arrays_zip(vector_to_array("s.mean"), vector_to_array("s.variance"))).alias("i", "c"),
    ).select("n", "i", F.col("c")["0"].alias("m"), F.col("c")["1"].alias("v"))
    per_column = Window.partitionBy("i")
    overall = F.sum(F.col("n") * F.col("m")).over(per_column) / F.sum("n").over(per_column)
    sums = (
        cells.withColumn("gap", F.col("m") - overall)
        .groupBy("i")
        .agg(
            F.count(F.lit(1)).alias("k"),
            F.sum("n").alias("n"),
            F.sum(F.col("n") * F.col("gap") * F.col("gap")).alias("between"),
            F.sum((F.col("n") - 1) * F.col("v")).alias("within"),
        )
        .collect()
    )
    out = dict.fromkeys(columns, math.nan)
    for r in sums:
        between, within = r["between"] / max(r["k"] - 1, 1), r["within"] / max(r["n"] - r["k"], 1)
        if within > 0:
            out[columns[r["i"]]] = between / within
        elif between > 0:
            out[columns[r["i"]]] = math.inf
    return out


_MOMENTS = "i int, n double, mx double, my double, xx double, yy double, xy double"


def _merged(parts: np.ndarray) -> np.ndarray:
    """Counts, means and centred sums (n, mx, my, xx, yy, xy) of several sets of rows together; ``parts`` is sets x columns x 6."""
    n = parts[..., 0]
    total = n.sum(axis=0)
    with np.errstate(invalid="ignore", divide="ignore"):
        mx, my = ((n * parts[..., k]).sum(axis=0) / total for k in (1, 2))
    dx, dy = parts[..., 1] - mx, parts[..., 2] - my
    out = [total, mx, my, *((parts[..., k] + n * u * v).sum(axis=0) for k, u, v in ((3, dx, dx), (4, dy, dy), (5, dx, dy)))]
    return np.nan_to_num(np.stack(out, axis=-1), nan=0.0, posinf=np.inf, neginf=-np.inf)


def regression_scores(df: DataFrame, columns: list[str], target: str) -> dict[str, float]:
    """Regression F of each column, r^2 / (1 - r^2) * (n - 2), n the rows with a target; one scan for all columns.

    A column's r takes the rows where it is not null. Centred sums are merged from batch to batch and from task to task.
    """
    names = [*columns, target]
    values = F.array(*[col(c).cast("double") for c in names])
    rows = df.where(col(target).isNotNull()).select(values.alias("v"))
    d = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, 6))
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d + 1)  # null is NaN
            known = ~np.isnan(v[:, :d]) & ~np.isnan(v[:, d:])
            n = known.sum(axis=0)
            x, y = np.where(known, v[:, :d], 0.0), np.where(known, v[:, d:], 0.0)
            mx, my = x.sum(axis=0) / np.maximum(n, 1), y.sum(axis=0) / np.maximum(n, 1)
            x, y = np.where(known, x - mx, 0.0), np.where(known, y - my, 0.0)
            part = np.stack([n, mx, my, (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)], axis=-1)
            total = _merged(np.stack([total, part]))
        yield pa.record_batch([pa.array(range(d), pa.int32()), *[pa.array(total[:, k]) for k in range(6)]], names=["i", "n", "mx", "my", "xx", "yy", "xy"])

    def merge(table: pa.Table) -> pa.Table:
        parts = np.stack([table.column(k).to_numpy() for k in range(1, 7)], axis=-1)[:, None, :]
        total = _merged(parts)[0]
        return pa.table([table.column("i")[:1], *[pa.array([v]) for v in total]], names=table.column_names)

    found = rows.mapInArrow(run, _MOMENTS).groupBy("i").applyInArrow(merge, _MOMENTS).collect()  # a row a column
    n = rows.count()
    out = dict.fromkeys(columns, math.nan)
    for s in found:
        if s["xx"] > 0 and s["yy"] > 0:
            r = s["xy"] ** 2 / (s["xx"] * s["yy"])
            out[columns[s["i"]]] = r / (1 - r) * (n - 2) if r < 1 else math.inf
    return out


def keep_count(numeric: int) -> int:
    return min(max(int(numeric * KEEP_SHARE), KEEP_AT_LEAST), numeric)


def top_k(scores: dict[str, float], k: int) -> list[str]:
    """Names with the k best scores, in their own order; undefined scores rank last.

    Of equal scores at the cut, the later column stays.
    """
    names = list(scores)

    def rank(i: int):
        score = scores[names[i]]
        return (-math.inf if math.isnan(score) else score, i)

    chosen = set(sorted(range(len(names)), key=rank)[len(names) - k :])
    return [c for i, c in enumerate(names) if i in chosen]


def fit_select(df: DataFrame, numeric: list[str], others: list[str], target: str, task: str) -> list[str]:
    """Features kept: all up to 30, else the best 80 % (30 at least) of the numeric ones."""
    if len(numeric) + len(others) <= SELECT_ABOVE or not numeric:
        return [*numeric, *others]
    score = anova_scores if task == "classification" else regression_scores
    return [*top_k(score(df, numeric, target), keep_count(len(numeric))), *others]
