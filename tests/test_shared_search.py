"""One fit or one neighbour search for all candidates that it can answer for."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabweave.models import neighbours, tuning
from tabweave.models.registry import build, measure_shape
from tabweave.models.tuning import evaluator, families, search, truncated


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((150, 3))
    rows = [(float(x[k, 0] > 0.2), float(x[k, 0] + x[k, 1] ** 2), k % 3, *map(float, x[k])) for k in range(150)]
    df = spark.createDataFrame(rows, "two double, y double, fold int, a double, b double, c double").coalesce(2)
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).cache()


def counted(monkeypatch, where, name):
    calls, plain = [], getattr(where, name)
    monkeypatch.setattr(where, name, lambda *a, **k: (calls.append(a), plain(*a, **k))[1])
    return calls


def test_families():
    points = [{"n_estimators": n, "max_depth": d} for d in (2, 3) for n in (5, 20, 10)]
    assert families("GradientBoostingRegressor", points) == [[1, 2, 0], [4, 5, 3]]
    points = [{"n_neighbors": k, "weights": w, "p": p} for k in (3, 5) for w in ("uniform", "distance") for p in (1, 2)]
    assert families("KNeighborsClassifier", points) == [[4, 6, 0, 2], [5, 7, 1, 3]]
    assert families("LogisticRegression", [{"C": 1.0}, {"C": 2.0}]) == [[0], [1]]


@pytest.mark.parametrize("algorithm, label", [("GradientBoostingRegressor", "y"), ("GradientBoostingClassifier", "two")])
def test_boosting_scores_equal_separate_fits(data, monkeypatch, algorithm, label):
    rows = data.withColumn("label", F.col(label))
    task = "regression" if label == "y" else "classification"
    points = [{"n_estimators": n, "max_depth": 2, "subsample": s} for s in (1.0, 0.7) for n in (1, 3)]
    shape = measure_shape(rows, task)
    calls = counted(monkeypatch, tuning, "build")
    found = search(rows, algorithm, task, points, shape, 3)
    assert len(calls) == 2 * 3 + 1  # families x folds, and the refit
    alone = [search(rows, algorithm, task, [p], shape, 3) for p in points]
    assert [s for _, s in found.tried] == pytest.approx([a.score for a in alone], abs=1e-12)
    best = max(range(len(points)), key=lambda i: alone[i].score)
    assert found.params == points[best] and found.spread == pytest.approx(alone[best].spread, abs=1e-9)


@pytest.mark.parametrize("algorithm, label", [("RandomForestRegressor", "y"), ("RandomForestClassifier", "two")])
def test_forest_scores_are_those_of_its_first_trees(data, monkeypatch, algorithm, label):
    rows = data.withColumn("label", F.col(label))
    task = "regression" if label == "y" else "classification"
    points = [{"n_estimators": n, "max_depth": 3} for n in (2, 6, 4)]
    shape = measure_shape(rows, task)
    calls = counted(monkeypatch, tuning, "build")
    found = search(rows, algorithm, task, points, shape, 3)
    assert len(calls) == 3 + 1
    whole = build(algorithm, points[1], shape).fit(rows.where("fold <> 0"))
    few = truncated(whole, 2)
    assert len(few.trees) == 2 and [t.toDebugString.split("\n", 1)[1] for t in few.trees] == [t.toDebugString.split("\n", 1)[1] for t in whole.trees[:2]]
    same = truncated(whole, 6).transform(rows).select("prediction").collect()
    assert same == whole.transform(rows).select("prediction").collect()
    by_hand = [evaluator(task).evaluate(truncated(build(algorithm, points[1], shape).fit(rows.where(F.col("fold") != k)), 2).transform(rows.where(F.col("fold") == k))) for k in range(3)]
    assert found.tried[0][1] == pytest.approx(sum(by_hand) / 3, abs=1e-12)


@pytest.mark.parametrize("algorithm, label", [("KNeighborsRegressor", "y"), ("KNeighborsClassifier", "two")])
def test_neighbour_scores_equal_separate_fits_from_one_search_a_fold_and_power(data, monkeypatch, algorithm, label):
    rows = data.withColumn("label", F.col(label))
    task = "regression" if label == "y" else "classification"
    points = [{"n_neighbors": k, "weights": w, "p": 2} for k in (1, 4) for w in ("uniform", "distance")]
    shape = measure_shape(rows, task)
    joins = counted(monkeypatch, neighbours, "knn_join")
    found = search(rows, algorithm, task, points, shape, 3, parallelism=2)
    assert len(joins) == 3
    for k, p in ((1, points[1]), (2, points[2])):
        assert found.tried[k][1] == pytest.approx(search(rows, algorithm, task, [p], shape, 3).score, abs=1e-12)
