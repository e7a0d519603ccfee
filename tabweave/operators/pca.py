"""Principal components up to a share of the variance."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import Identifiable
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.operators.gram import START, Gram
from tabweave.operators.selection import assemble
from tabweave.plans.roles import col

PCA_ABOVE = 50
PCA_VARIANCE = 0.95
DIRECT_COLUMNS = 1024
"""Up to so many columns the covariance is solved as a whole on the driver; beyond, by products with its blocks."""


def component_count(shares: list[float], variance: float = PCA_VARIANCE) -> int:
    """Fewest components whose shares add up to more than ``variance``."""
    total = np.cumsum(shares)
    return int(min(np.searchsorted(total, variance, side="right") + 1, len(shares)))


def fit_pca(
    df: DataFrame, columns: list[str], variance: float = PCA_VARIANCE, direct: int = DIRECT_COLUMNS, start: int = START
) -> tuple[dict, PCAModel]:
    """Fit on a distributed covariance, solved on the driver up to ``direct`` columns.

    With more columns the covariance stays a table of blocks, and a randomized subspace, doubled until it holds ``variance``, takes the
    leading components out of it; the driver holds columns x components. Spark's model neither centres new rows nor fixes signs, so
    the spec carries the projected mean and a sign per component (its largest loading is positive). The spec says how many components
    of the model count.
    """
    data = assemble(df, columns)
    if len(columns) <= direct:
        model = PCA(k=len(columns), inputCol="features", outputCol="pc").fit(data)
        shares, loadings = model.explainedVariance.toArray(), model.pc.toArray()
    else:
        loadings, variances, total = Gram(df, columns).leading(variance, start)
        shares = variances / total if total else np.zeros(len(variances))
        java = JavaWrapper._new_java_obj(
            "org.apache.spark.ml.feature.PCAModel",
            Identifiable().uid,
            DenseMatrix(len(columns), len(shares), loadings.ravel(order="F").tolist()),
            DenseVector(shares),
        )
        model = PCAModel(java).setInputCol("features").setOutputCol("pc")
        model._set(k=len(shares))
    k = component_count(shares.tolist(), variance)
    mean = data.agg(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray()
    loadings = loadings[:, :k]
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    spec = {
        "op": "pca",
        "columns": columns,
        "offsets": (mean @ loadings).tolist(),
        "signs": signs.tolist(),
        "shares": shares[:k].tolist(),
    }
    return spec, model


def apply_pca(df: DataFrame, spec: dict, model: PCAModel) -> DataFrame:
    """Replace the columns by ``PC1``, ``PC2`` and so on."""
    others = [c for c in df.columns if c not in spec["columns"]]
    projected = model.transform(assemble(df, spec["columns"], others)).withColumn("pc", vector_to_array("pc"))
    parts = [
        ((F.col("pc")[i] - offset) * sign).alias(f"PC{i + 1}")
        for i, (offset, sign) in enumerate(zip(spec["offsets"], spec["signs"]))
    ]
    return projected.select(*[col(c) for c in others], *parts)
