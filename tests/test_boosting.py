"""Boosting by the softmax loss, against the same steps in NumPy."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabweave.models import boosting
from tabweave.models.boosting import SoftmaxBoosting, SoftmaxBoostingModel


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((240, 3))
    y = np.where(x[:, 0] > 0.4, 0, np.where(x[:, 1] * x[:, 2] > 0, 1, 2))
    rows = [(k, float(y[k]) if k % 40 else None, *map(float, x[k])) for k in range(240)]
    df = spark.createDataFrame(rows, "k int, label double, a double, b double, c double").repartition(2)
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).cache()


@pytest.fixture(scope="module")
def model(data):
    return SoftmaxBoosting(classes=3, maxIter=4, stepSize=0.3, maxDepth=2).fit(data)


def test_each_round_is_a_newton_step_and_lowers_the_loss(data, model):
    rows = data.where("label is not null").select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y")).collect()
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows])
    share = np.bincount(y) / len(y)
    assert np.allclose(model.start, np.log(share))
    raw = np.tile(model.start, (len(x), 1))
    losses = []
    for trees in model.rounds:
        p = boosting.softmax(raw)
        losses.append(-np.log(p[np.arange(len(y)), y]).mean())
        step = np.zeros_like(raw)
        for c, tree in enumerate(trees):
            g = (y == c) - p[:, c]
            assert 2 <= len(tree.leaves) <= 4
            at = tree.with_values(list(range(len(tree.leaves)))).predict(x)
            for leaf in range(len(tree.leaves)):
                r = g[at == leaf]
                assert len(r)
                step[at == leaf, c] = 0.3 * 2 / 3 * r.sum() / (np.abs(r) * (1 - np.abs(r))).sum()
            assert np.allclose(tree.predict(x), step[:, c])
        raw += step
    losses.append(-np.log(boosting.softmax(raw)[np.arange(len(y)), y]).mean())
    assert np.allclose(losses, model.losses) and all(b < a for a, b in zip(losses, losses[1:]))
    made = model.transform(data.where("label is not null")).select(vector_to_array("probability").alias("p"), "prediction").collect()
    assert np.allclose([r.p for r in made], boosting.softmax(raw)) and [r.prediction for r in made] == raw.argmax(axis=1).tolist()


def test_trees_are_read_as_spark_predicts(spark, data):
    from pyspark.ml.regression import DecisionTreeRegressor

    fitted = DecisionTreeRegressor(labelCol="y", maxDepth=5).fit(data.withColumn("y", F.sin("a") * F.col("b")))
    holed = data.select("a", "b", F.when(F.col("k") % 3 == 0, float("nan")).otherwise(F.col("c")).alias("c"))
    rows = fitted.transform(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features", handleInvalid="keep").transform(holed)).collect()
    x = np.array([r.features.toArray() for r in rows])
    assert np.allclose(boosting.read_tree(fitted).predict(x), [r.prediction for r in rows])


def test_first_rounds_equal_a_smaller_fit_and_survive_saving(data, model, tmp_path):
    small = SoftmaxBoosting(classes=3, maxIter=2, stepSize=0.3, maxDepth=2).fit(data)
    assert model.first(2).rounds == small.rounds and model.first(2).losses == small.losses
    PipelineModel([model]).save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).stages[0]
    assert isinstance(again, SoftmaxBoostingModel) and again.rounds == model.rounds and again.losses == model.losses
    assert again.transform(data).select("k", "prediction").collect() == model.transform(data).select("k", "prediction").collect()


def test_edges(spark, data):
    with pytest.raises(ValueError, match="no labelled rows"):
        SoftmaxBoosting(classes=3).fit(data.where("label is null"))
    one = SoftmaxBoosting(classes=3, maxIter=2).fit(data.withColumn("label", F.lit(1.0)))
    assert {r.prediction for r in one.transform(data).collect()} == {1.0} and np.isfinite(one.losses).all()
    drawn = [SoftmaxBoosting(classes=3, maxIter=2, subsamplingRate=0.5, seed=7).fit(data).rounds for _ in range(2)]
    assert drawn[0] == drawn[1]
    assert one.transform(data.limit(0)).count() == 0
