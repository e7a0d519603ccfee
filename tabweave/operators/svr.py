"""Linear regression with an epsilon-insensitive loss, fitted by aggregates over the rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMOOTHING = 0.01
MEMORY = 8
ARMIJO = 1e-4
HALVINGS = 20
TOLERANCE = 1e-6
#: What one block of rows holds; a pass reads blocks, not rows.
BLOCK_BYTES = 1 << 18


def packed(rows: DataFrame) -> DataFrame:
    """``(n, width, block)``: the rows ``(x, y)`` as blocks of 8-byte numbers, all x row by row, then all y."""

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            y = batch.column("y").to_numpy()
            size = max(1, BLOCK_BYTES // (8 * (x.shape[1] + 1)))
            for k in range(0, len(x), size):
                part, last = x[k : k + size], y[k : k + size]
                block = pa.array([part.tobytes() + last.tobytes()], "binary")
                yield pa.record_batch([pa.array([len(part)], "int32"), pa.array([x.shape[1]], "int32"), block], names=["n", "width", "block"])

    return rows.mapInArrow(pack, "n int, width int, block binary")


def _loss_and_gradient(blocks: DataFrame, weights: np.ndarray, epsilon: float, smooth: float):
    """Sum of losses and its gradient: one pass, a partial sum per task, d + 2 numbers read.

    The kink at epsilon is rounded by a parabola of width ``smooth`` so that the gradient exists.
    """
    w, b = weights[:-1].copy(), float(weights[-1])

    def partial(batches):
        total, grad = 0.0, np.zeros(len(w) + 1)
        for batch in batches:
            for block in batch.column("block"):
                numbers = np.frombuffer(block.as_buffer())
                x, y = np.split(numbers, [len(numbers) // (len(w) + 1) * len(w)])
                x = x.reshape(len(y), len(w))
                residual = x @ w + b - y
                over = np.abs(residual) - epsilon
                curved = (over > 0) & (over < smooth)
                total += np.where(curved, over**2 / (2 * smooth), np.where(over > 0, over - smooth / 2, 0.0)).sum()
                slope = np.sign(residual) * np.clip(over / smooth, 0.0, 1.0)
                grad[:-1] += slope @ x
                grad[-1] += slope.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w) + 2, dtype="int32")), pa.array([*grad, total])], ["i", "v"])

    summed = blocks.select("block").mapInArrow(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(w) + 2)
    for row in summed:
        out[row["i"]] = row["v"]
    return out[-1], out[:-1]


def fit_epsilon_regression(
    blocks: DataFrame, count: int, width: int, c: float, epsilon: float, max_iter: int, start: float, smooth: float
) -> tuple[np.ndarray, list[float]]:
    """Minimise ``|w|^2 / (2 c n) + mean loss`` by limited-memory BFGS; returns weights and losses.

    ``blocks`` is what :func:`packed` makes. The driver keeps a few d-vectors; each evaluation is one Spark aggregate.
    """

    def objective(weights: np.ndarray):
        loss, grad = _loss_and_gradient(blocks, weights, epsilon, smooth)
        ridge = weights.copy()
        ridge[-1] = 0.0
        return loss / count + ridge @ ridge / (2 * c * count), grad / count + ridge / (c * count)

    weights = np.zeros(width + 1)
    weights[-1] = start
    value, grad = objective(weights)
    history, steps, changes = [value], [], []
    for _ in range(max_iter):
        if np.abs(grad).max() < TOLERANCE:
            break
        direction, stack = -grad, []
        for s, y in zip(reversed(steps), reversed(changes)):
            a = (s @ direction) / (s @ y)
            direction = direction - a * y
            stack.append(a)
        if steps:
            direction = direction * (steps[-1] @ changes[-1]) / (changes[-1] @ changes[-1])
        for s, y, a in zip(steps, changes, reversed(stack)):
            direction = direction + s * (a - (y @ direction) / (s @ y))
        slope = grad @ direction
        if slope >= 0:
            direction, slope, steps, changes = -grad, -(grad @ grad), [], []
        size = 1.0 if steps else 1.0 / max(1.0, np.linalg.norm(grad))
        for _ in range(HALVINGS):
            tried, tried_grad = objective(weights + size * direction)
            if tried <= value + ARMIJO * size * slope:
                break
            size /= 2
        else:
            break
        s, y = size * direction, tried_grad - grad
        weights, done = weights + s, value - tried
        value, grad = tried, tried_grad
        history.append(value)
        if s @ y > 1e-12:
            steps, changes = [*steps, s][-MEMORY:], [*changes, y][-MEMORY:]
        if done < TOLERANCE * max(1.0, abs(value)):
            break
    return weights, history


class EpsilonRegression(
    Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasMaxIter, DefaultParamsReadable, DefaultParamsWritable
):
    """Support vector regression with a linear kernel."""

    c = Param(Params._dummy(), "c", "weight of the losses", TypeConverters.toFloat)
    epsilon = Param(Params._dummy(), "epsilon", "width of the tube without loss", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", c=1.0, epsilon=0.1, maxIter=40):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", c=1.0, epsilon=0.1, maxIter=40)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> EpsilonRegressionModel:
        y = dataset[self.getLabelCol()].cast("double").alias("y")
        rows = dataset.select(vector_to_array(dataset[self.getFeaturesCol()]).alias("x"), y)
        facts = dataset.select(y).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("spread")).first()
        if not facts["n"]:
            raise ValueError("no rows to fit")
        blocks = packed(rows).persist(StorageLevel.MEMORY_AND_DISK)
        weights, history = fit_epsilon_regression(
            blocks,
            facts["n"],
            blocks.agg(F.first("width")).first()[0],
            self.getOrDefault(self.c),
            self.getOrDefault(self.epsilon),
            self.getMaxIter(),
            facts["mean"],
            SMOOTHING * (facts["spread"] or 1.0),
        )
        blocks.unpersist()
        model = EpsilonRegressionModel(
            featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(), weights=weights.tolist()
        )
        model.history = history
        return model


class EpsilonRegressionModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    weights = Param(Params._dummy(), "weights", "coefficients, then the intercept", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, featuresCol="features", predictionCol="prediction", weights=None):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        *w, b = self.getOrDefault(self.weights)
        terms = F.zip_with(
            vector_to_array(dataset[self.getFeaturesCol()]), F.array(*[F.lit(v) for v in w]), lambda x, y: x * y
        )
        return dataset.withColumn(self.getPredictionCol(), F.aggregate(terms, F.lit(b), lambda acc, t: acc + t))
