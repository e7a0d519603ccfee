"""k-nearest-neighbour estimator on the distributed join."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.operators.knn import average, knn_join, vote
from tabweave.plans.roles import col
from tabweave.session import materialize


class _NeighbourParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)
    p = Param(Params._dummy(), "p", "Minkowski power, 1 or 2", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "uniform or distance", TypeConverters.toString)
    task = Param(Params._dummy(), "task", "classification or regression", TypeConverters.toString)

    def _defaults(self):
        self._setDefault(
            featuresCol="features", labelCol="label", predictionCol="prediction", k=5, p=2, weights="uniform", task="classification"
        )


class Neighbours(Estimator, _NeighbourParams, DefaultParamsReadable, DefaultParamsWritable):
    """Keeps the training rows as a table in the shared folder."""

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", k=5, p=2, weights="uniform", task="classification"):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> NeighboursModel:
        rows = dataset.select(
            F.xxhash64(dataset[self.getFeaturesCol()], dataset[self.getLabelCol()].cast("double")).alias("train_id"),
            vector_to_array(dataset[self.getFeaturesCol()]).alias("train_vector"),
            dataset[self.getLabelCol()].cast("double").alias("label"),
        )
        model = NeighboursModel()
        self._copyValues(model)
        model.train = materialize(rows, "knn-train")
        return model


class _NeighboursWriter(MLWriter):
    def __init__(self, model: NeighboursModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.train.write.parquet(f"{path}/train")


class _NeighboursReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> NeighboursModel:
        spark = SparkSession.getActiveSession()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.train = spark.read.parquet(f"{path}/train")
        return model


class NeighboursModel(Model, _NeighbourParams, MLReadable, MLWritable):
    train: DataFrame

    def __init__(self):
        super().__init__()
        self._defaults()

    def write(self) -> _NeighboursWriter:
        return _NeighboursWriter(self)

    def save(self, path: str) -> None:
        self.write().save(path)

    @classmethod
    def read(cls) -> _NeighboursReader:
        return _NeighboursReader(cls)

    @classmethod
    def load(cls, path: str) -> NeighboursModel:
        return cls.read().load(path)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Predict every row. Equal vectors are one query, so neither ties nor retries depend on places."""
        made = self._answered(dataset, [(self.getOrDefault(self.k), self.getOrDefault(self.weights))])
        return made.withColumnRenamed("__prediction0", self.getPredictionCol())

    def transform_many(self, dataset: DataFrame, settings: list[tuple[int, str]]) -> DataFrame:
        """Columns __prediction0, __prediction1, ... for each (k, weights), from one search for the largest k."""
        return self._answered(dataset, settings)

    def _answered(self, dataset: DataFrame, settings: list[tuple[int, str]]) -> DataFrame:
        rows = materialize(dataset.select("*", F.xxhash64(col(self.getFeaturesCol())).alias("__row_id")), "knn-queries")
        queries = rows.select(
            F.col("__row_id").alias("query_id"), vector_to_array(col(self.getFeaturesCol())).alias("query_vector")
        ).dropDuplicates(["query_id"])
        found = knn_join(queries, self.train, max(k for k, _ in settings), self.getOrDefault(self.p))
        if len(settings) > 1:
            found = materialize(found, "knn-found")
        answer = vote if self.getOrDefault(self.task) == "classification" else average
        out = rows
        for n, (k, weights) in enumerate(settings):
            predicted = answer(found.where(F.col("rank") <= k), weights)
            out = out.join(predicted.select(F.col("query_id").alias("__row_id"), F.col("prediction").alias(f"__prediction{n}")), "__row_id", "left")
        return out.drop("__row_id")
