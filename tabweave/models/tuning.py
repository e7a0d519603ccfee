"""Cross-validated search over a grid, with Spark's CrossValidator."""

from __future__ import annotations

import itertools
import random
import statistics
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.evaluation import Evaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.regression import GBTRegressionModel
from pyspark.ml.tuning import CrossValidator
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.models.boosting import SoftmaxBoostingModel
from tabweave.models.registry import Shape, build, grid, spark_params
from tabweave.session import tasks_for

MOST_FITS = 500
RANDOM_DRAWS = 50


@dataclass
class SearchResult:
    model: Model
    params: dict
    score: float | None
    spread: float | None
    tried: list[tuple[dict, float]]


def evaluator(task: str) -> Evaluator:
    if task == "classification":
        return MulticlassClassificationEvaluator(metricName="accuracy")
    return RegressionEvaluator(metricName="r2")


def grid_points(space: dict[str, list]) -> list[dict]:
    names = list(space)
    return [dict(zip(names, values)) for values in itertools.product(*space.values())]


def candidates(algorithm: str, task: str, folds: int, seed: int = 42) -> tuple[str, list[dict]]:
    """``('grid' | 'random', points)``: the whole grid up to 500 fits, else 50 draws by seed."""
    points = grid_points(grid(algorithm, task))
    if len(points) * folds <= MOST_FITS:
        return "grid", points
    return "random", random.Random(seed).sample(points, RANDOM_DRAWS)


def distinct_candidates(algorithm: str, points: list[dict]) -> list[dict]:
    """Points that differ after mapping to Spark's parameters; the first of equals stays."""
    seen, out = set(), []
    for point in points:
        key = tuple(sorted((k, repr(v)) for k, v in spark_params(algorithm, point).items()))
        if key not in seen:
            seen.add(key)
            out.append(point)
    return out


#: Settings that a model fitted at the largest value answers for the smaller ones.
STAGED = ("numTrees", "maxIter")


def families(algorithm: str, points: list[dict]) -> list[list[int]]:
    """Places of points that one fit serves: ensembles that differ in their number of trees, neighbours in their number and weights.

    Each family begins with the point that is fitted, the one with most trees or neighbours; points of other algorithms are alone.
    """
    tree = algorithm.startswith(("RandomForest", "GradientBoosting"))
    near = algorithm.startswith("KNeighbors")
    found: dict[str, list[int]] = {}
    for i, point in enumerate(points):
        settings = spark_params(algorithm, point)
        if tree:
            settings = {k: v for k, v in settings.items() if k not in STAGED}
        elif near:
            settings = {"p": settings["p"]}
        found.setdefault(repr(sorted(settings.items())) if tree or near else str(i), []).append(i)
    return [sorted(f, key=lambda i: (-_size(algorithm, points[i]), i)) for f in found.values()]


def _size(algorithm: str, point: dict) -> int:
    settings = spark_params(algorithm, point)
    return next((settings[k] for k in (*STAGED, "k") if k in settings), 0)


def truncated(model: Model, trees: int) -> Model:
    """The ensemble of the first ``trees`` trees of a fitted one.

    For boosting this is what a fit of so many trees makes. A forest's first trees are as good a forest of that size as another draw.
    """
    if isinstance(model, SoftmaxBoostingModel):
        return model.first(trees)
    java, context = model._java_obj, SparkContext._active_spark_context
    first = [java.trees()[k] for k in range(trees)]
    kind = context._jvm.java.lang.Class.forName(first[0].getClass().getName())
    array = context._jvm.java.lang.reflect.Array.newInstance(kind, trees)
    for k, t in enumerate(first):
        array[k] = t
    if isinstance(model, (GBTClassificationModel, GBTRegressionModel)):
        weights = JavaWrapper._new_java_array(list(model.treeWeights[:trees]), context._gateway.jvm.double)
        made = JavaWrapper._new_java_obj(java.getClass().getName(), model.uid, array, weights)
    elif isinstance(model, RandomForestClassificationModel):
        made = JavaWrapper._new_java_obj(java.getClass().getName(), model.uid, array, model.numFeatures, model.numClasses)
    else:
        made = JavaWrapper._new_java_obj(java.getClass().getName(), model.uid, array, model.numFeatures)
    out = type(model)(made)
    model._copyValues(out)
    out._set(**{next(n for n in STAGED if out.hasParam(n)): trees})
    return out


def dealt(data: DataFrame, algorithm: str, shape: Shape) -> DataFrame:
    """Rows for a fit of trees, whose tasks hold their partition of all rows as objects: in more partitions where the table has too few."""
    wanted = tasks_for(shape.rows, shape.width)
    if not algorithm.startswith(("RandomForest", "DecisionTree", "GradientBoosting")) or wanted <= data.rdd.getNumPartitions():
        return data
    return data.repartition(wanted)


def _family_scores(
    data: DataFrame, algorithm: str, task: str, points: list[dict], family: list[int], shape: Shape, fold_column: str, k: int, seed: int
) -> dict[int, float]:
    """Scores on one fold of all points of a family, from one fit."""
    train, test = (data.where(F.col(fold_column) != k), data.where(F.col(fold_column) == k))
    fitted = build(algorithm, points[family[0]], shape, seed).fit(dealt(train, algorithm, shape))
    judge = evaluator(task)
    if algorithm.startswith("KNeighbors"):
        settings = [spark_params(algorithm, points[i]) for i in family]
        made = fitted.transform_many(test, [(s["k"], s["weights"]) for s in settings])
        return {i: judge.setPredictionCol(f"__prediction{n}").evaluate(made) for n, i in enumerate(family)}
    return {i: judge.evaluate(truncated(fitted, _size(algorithm, points[i])).transform(test)) for i in family}


def _shared_search(data: DataFrame, algorithm: str, task: str, points: list[dict], shape: Shape, folds: int, fold_column: str, seed: int, parallelism: int) -> SearchResult:
    jobs = [(f, k) for f in families(algorithm, points) for k in range(folds)]
    scores: list[list[float]] = [[0.0] * folds for _ in points]
    with ThreadPoolExecutor(parallelism) as pool:
        for (_, k), found in zip(jobs, pool.map(lambda j: _family_scores(data, algorithm, task, points, j[0], shape, fold_column, j[1], seed), jobs)):
            for i, score in found.items():
                scores[i][k] = score
    means = [statistics.fmean(s) for s in scores]
    best = max(range(len(points)), key=lambda i: means[i])
    model = Pipeline(stages=[build(algorithm, points[best], shape, seed)]).fit(dealt(data, algorithm, shape))
    return SearchResult(model, points[best], means[best], statistics.pstdev(scores[best]) * 2, list(zip(points, means)))


def search(
    data: DataFrame,
    algorithm: str,
    task: str,
    points: list[dict],
    shape: Shape,
    folds: int,
    fold_column: str = "fold",
    seed: int = 42,
    parallelism: int = 4,
) -> SearchResult:
    """Score every point on given folds and refit the best on all rows.

    Points that differ in the number of trees or neighbours only share one fit a fold. Each other candidate is a one-stage pipeline, so
    estimators of any class share one search.
    """
    if any(len(f) > 1 for f in families(algorithm, points)):
        return _shared_search(data, algorithm, task, points, shape, folds, fold_column, seed, parallelism)
    holder = Pipeline(stages=[])
    maps = [{holder.stages: [build(algorithm, p, shape, seed)]} for p in points]
    found = CrossValidator(
        estimator=holder,
        estimatorParamMaps=maps,
        evaluator=evaluator(task),
        numFolds=folds,
        foldCol=fold_column,
        seed=seed,
        parallelism=parallelism,
    ).fit(dealt(data, algorithm, shape))
    best = max(range(len(points)), key=lambda i: found.avgMetrics[i])
    return SearchResult(
        found.bestModel,
        points[best],
        found.avgMetrics[best],
        found.stdMetrics[best] * 2,
        list(zip(points, found.avgMetrics)),
    )


def cross_score(
    data: DataFrame, algorithm: str, task: str, params: dict, shape: Shape, folds: int, fold_column: str = "fold", seed: int = 42
) -> tuple[float, float]:
    """Mean score over the folds and two deviations, without a fit on all rows."""
    scores = []
    for k in range(folds):
        fitted = Pipeline(stages=[build(algorithm, params, shape, seed)]).fit(dealt(data.where(F.col(fold_column) != k), algorithm, shape))
        scores.append(evaluator(task).evaluate(fitted.transform(data.where(F.col(fold_column) == k))))
    return statistics.fmean(scores), statistics.pstdev(scores) * 2


def fit_default(data: DataFrame, algorithm: str, shape: Shape, seed: int = 42, params: dict | None = None) -> SearchResult:
    """One fit without tuning."""
    params = params or {}
    model = Pipeline(stages=[build(algorithm, params, shape, seed)]).fit(dealt(data, algorithm, shape))
    return SearchResult(model, params, None, None, [])
