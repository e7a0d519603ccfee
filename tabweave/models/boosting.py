"""Gradient boosting for several classes by the softmax loss.

Each round fits one regression tree a class, all on the gradients of one model: a class's residual is 1 or 0 for the row's class less its
softmax share. A leaf's value is a Newton step from the sums of its residuals. Scores of all rows lie in one table, written anew each
round; the table of the round before is dropped.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tabweave.session import drop_table, scratch_path

PARALLEL_TREES = 4


@dataclass(frozen=True)
class Tree:
    """A regression tree as arrays: a node has a feature (-1: a leaf), a threshold, two children, and a value."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]

    @property
    def leaves(self) -> list[int]:
        return [k for k, f in enumerate(self.feature) if f < 0]

    def with_values(self, values: list[float]) -> Tree:
        """The same splits with other values, one a leaf in order."""
        out = list(self.value)
        for k, v in zip(self.leaves, values):
            out[k] = v
        return Tree(self.feature, self.threshold, self.left, self.right, out)

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        feature, threshold, left, right = (np.array(v) for v in (self.feature, self.threshold, self.left, self.right))
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return np.array(self.value)[at]
            node = at[inner]
            # as Spark does: NaN is not below a threshold
            at[inner] = np.where(x[inner, feature[node]] <= threshold[node], left[node], right[node])


_IF = re.compile(r"^(\s*)If \(feature (\d+) <= (\S+)\)$")
_PREDICT = re.compile(r"^\s*Predict: (\S+)$")


def read_tree(model: DecisionTreeRegressionModel) -> Tree:
    """The splits of a fitted tree over continuous features, read from Spark's description; leaves in the order of its leaf numbers."""
    lines = iter(model.toDebugString.splitlines()[1:])
    tree = Tree([], [], [], [], [])

    def node() -> int:
        line = next(lines)
        at = len(tree.feature)
        found, leaf = _IF.match(line), _PREDICT.match(line)
        if not found and not leaf:
            raise ValueError(f"no split of a continuous feature: {line.strip()}")
        tree.feature.append(int(found[2]) if found else -1)
        tree.threshold.append(float(found[3]) if found else 0.0)
        tree.left.append(-1)
        tree.right.append(-1)
        tree.value.append(0.0 if found else float(leaf[1]))
        if found:
            tree.left[at] = node()
            next(lines)  # Else
            tree.right[at] = node()
        return at

    node()
    return tree


def scores(rounds: list[list[Tree]], start: list[float], x: np.ndarray) -> np.ndarray:
    """Raw scores, rows x classes, after all rounds."""
    return scores_by_round(rounds, start, x, [len(rounds)])[0]


def scores_by_round(rounds: list[list[Tree]], start: list[float], x: np.ndarray, wanted: list[int]) -> list[np.ndarray]:
    """Raw scores after the first 1, 2, ... rounds, for the ascending numbers of rounds ``wanted``."""
    total, out = np.tile(np.array(start), (len(x), 1)), []
    for n in range(max(wanted) + 1):
        out += [total.copy() for w in wanted if w == n]
        if n < max(wanted):
            total += np.stack([t.predict(x) for t in rounds[n]], axis=1)
    return out


def softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class _BoostingParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed):
    classes = Param(Params._dummy(), "classes", "number of classes; labels are 0 to classes - 1", TypeConverters.toInt)
    maxIter = Param(Params._dummy(), "maxIter", "rounds", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "share of each Newton step", TypeConverters.toFloat)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "rows of a leaf", TypeConverters.toInt)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of the rows that a round's trees are fitted on", TypeConverters.toFloat)

    def _defaults(self):
        self._setDefault(
            featuresCol="features", labelCol="label", predictionCol="prediction", seed=42,
            maxIter=100, stepSize=0.1, maxDepth=3, minInstancesPerNode=1, subsamplingRate=1.0,
        )


class SoftmaxBoosting(Estimator, _BoostingParams, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees over all classes at once. ``losses`` of the model has the mean training loss before each round and after the last."""

    @keyword_only
    def __init__(self, classes=2, maxIter=100, stepSize=0.1, maxDepth=3, minInstancesPerNode=1, subsamplingRate=1.0, seed=42, featuresCol="features", labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> SoftmaxBoostingModel:
        k = self.getOrDefault(self.classes)
        label = dataset[self.getLabelCol()].cast("int")
        rows = dataset.where(dataset[self.getLabelCol()].isNotNull()).select(dataset[self.getFeaturesCol()].alias("features", metadata={}), label.alias("label"))
        spark = dataset.sparkSession
        counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        n = sum(counts.values())
        if not n:
            raise ValueError("no labelled rows to fit on")
        floor = np.finfo(np.float32).eps  # a class without rows has a small prior share
        start = [float(np.log(min(max(counts.get(c, 0) / n, floor), 1 - floor))) for c in range(k)]
        path = scratch_path(spark, "boosting")
        rows.select("features", "label", F.array(*map(F.lit, start)).alias("raw")).write.parquet(path)
        rounds, losses = [], []
        for m in range(self.getOrDefault(self.maxIter)):
            table = spark.read.parquet(path)
            made, loss = self._round(table, k, m)
            rounds.append(made)
            losses.append(loss)
            new = scratch_path(spark, "boosting")
            self._added(table, made).write.parquet(new)
            drop_table(spark, path)
            path = new
        losses.append(_loss(spark.read.parquet(path)))
        drop_table(spark, path)
        model = SoftmaxBoostingModel()
        self._copyValues(model)
        model.start, model.rounds, model.losses = start, rounds, losses
        return model

    def _round(self, table: DataFrame, k: int, number: int) -> tuple[list[Tree], float]:
        """One tree a class on the gradients of ``table``, and the loss before it."""
        top = F.array_max("raw")
        parts = F.transform("raw", lambda r: F.exp(r - top))
        shares = table.select("features", "label", "raw", F.transform(parts, lambda e: e / F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)).alias("p"))
        residuals = [(F.when(F.col("label") == c, 1.0).otherwise(0.0) - F.col("p")[c]).alias(f"g{c}") for c in range(k)]
        data = shares.select("features", "label", "raw", *residuals)
        share, seed = self.getOrDefault(self.subsamplingRate), self.getSeed()
        used = data
        if share < 1.0:
            # drawn by what a row holds and the round, so a repeated task draws the same
            draw = F.pmod(F.xxhash64("features", "label", F.lit(seed), F.lit(number)), F.lit(1 << 30)) / (1 << 30)
            used = data.where(draw < share)

        def fit(c: int) -> DecisionTreeRegressionModel:
            return DecisionTreeRegressor(
                featuresCol="features", labelCol=f"g{c}", predictionCol=f"m{c}", leafCol=f"leaf{c}", maxDepth=self.getOrDefault(self.maxDepth),
                minInstancesPerNode=self.getOrDefault(self.minInstancesPerNode), seed=seed,
            ).fit(used)

        with ThreadPoolExecutor(PARALLEL_TREES) as pool:
            fitted = list(pool.map(fit, range(k)))
        placed = used
        for model in fitted:
            placed = model.transform(placed)
        cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"leaf{c}").cast("int").alias("leaf"), F.col(f"g{c}").alias("g")) for c in range(k)])
        size = F.abs("g")
        sums = placed.select(F.inline(cells)).groupBy("c", "leaf").agg(F.sum("g").alias("up"), F.sum(size * (1 - size)).alias("down")).collect()  # a row a leaf
        step = {(r["c"], r["leaf"]): (k - 1) / k * r["up"] / r["down"] if r["down"] > 1e-150 else 0.0 for r in sums}
        rate, out = self.getOrDefault(self.stepSize), []
        for c, model in enumerate(fitted):
            tree = read_tree(model)
            out.append(tree.with_values([rate * step.get((c, leaf), 0.0) for leaf in range(len(tree.leaves))]))
        return out, _loss(table)

    @staticmethod
    def _added(table: DataFrame, trees: list[Tree]) -> DataFrame:
        @pandas_udf("array<double>")
        def add(x: pd.Series, raw: pd.Series) -> pd.Series:
            if not len(x):
                return raw
            v = np.vstack(x.to_list())
            return pd.Series(list(np.vstack(raw.to_list()) + np.stack([t.predict(v) for t in trees], axis=1)))

        return table.select("features", "label", add(vector_to_array("features"), F.col("raw")).alias("raw"))


def _loss(table: DataFrame) -> float:
    """Mean of the negative log share of the rows' classes."""
    top = F.array_max("raw")
    total = F.log(F.aggregate("raw", F.lit(0.0), lambda a, r: a + F.exp(r - top))) + top
    return table.agg(F.avg(total - F.element_at("raw", F.col("label") + 1)).alias("l")).first()["l"]


class _BoostingWriter(MLWriter):
    def __init__(self, model: SoftmaxBoostingModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        rows = [(m, c, json.dumps(t.__dict__)) for m, trees in enumerate(self.model.rounds) for c, t in enumerate(trees)]
        rows.append((-1, -1, json.dumps({"start": self.model.start, "losses": self.model.losses})))
        self.sparkSession.createDataFrame(rows, "round int, class int, tree string").coalesce(1).write.parquet(f"{path}/trees")


class _BoostingReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> SoftmaxBoostingModel:
        spark = SparkSession.getActiveSession()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.rounds = []
        for r in spark.read.parquet(f"{path}/trees").orderBy("round", "class").collect():
            values = json.loads(r["tree"])
            if r["round"] < 0:
                model.start, model.losses = values["start"], values["losses"]
                continue
            if r["class"] == 0:
                model.rounds.append([])
            model.rounds[-1].append(Tree(**values))
        return model


class SoftmaxBoostingModel(Model, _BoostingParams, MLReadable, MLWritable):
    """Adds ``probability`` and the prediction, the class with the largest share, the first of equals."""

    start: list[float]
    rounds: list[list[Tree]]
    losses: list[float]

    def __init__(self):
        super().__init__()
        self._defaults()

    def write(self) -> _BoostingWriter:
        return _BoostingWriter(self)

    def save(self, path: str) -> None:
        self.write().save(path)

    @classmethod
    def read(cls) -> _BoostingReader:
        return _BoostingReader(cls)

    @classmethod
    def load(cls, path: str) -> SoftmaxBoostingModel:
        return cls.read().load(path)

    def first(self, rounds: int) -> SoftmaxBoostingModel:
        """The model of the first rounds, as a fit of so many would have made it."""
        model = SoftmaxBoostingModel()
        self._copyValues(model)
        model._set(maxIter=rounds)
        model.start, model.rounds, model.losses = self.start, self.rounds[:rounds], self.losses[: rounds + 1]
        return model

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shared = dataset.sparkSession.sparkContext.broadcast((self.rounds, self.start))

        @pandas_udf("array<double>")
        def shares(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            rounds, start = shared.value
            for x in batches:
                yield pd.Series(list(softmax(scores(rounds, start, np.vstack(x.to_list()))))) if len(x) else x

        made = dataset.withColumn("__shares", shares(vector_to_array(self.getFeaturesCol())))
        best = F.array_position("__shares", F.array_max("__shares")) - 1
        return made.withColumns({"probability": array_to_vector("__shares"), self.getPredictionCol(): best.cast("double")}).drop("__shares")
