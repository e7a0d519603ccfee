"""The twelve estimators, their search grids and how parameters map to Spark's."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.models.boosting import SoftmaxBoosting
from tabweave.models.neighbours import Neighbours
from tabweave.operators.fourier import FourierMap
from tabweave.operators.kernel_svc import KernelSVC
from tabweave.operators.svr import EpsilonRegression

DEEPEST = 30
"""Spark's depth cap, used for unlimited depth."""

# The parameter grids that are searched.
FOREST_GRID = {
    "n_estimators": [50, 100, 200, 300],
    "max_depth": [5, 10, 15, 20, None],
    "min_samples_split": [2, 5, 10],
    "min_samples_leaf": [1, 2, 4],
    "max_features": ["auto", "sqrt", "log2"],
    "bootstrap": [True, False],
}
TREE_GRID = {
    "max_depth": [3, 5, 7, 10, 15, 20, None],
    "min_samples_split": [2, 5, 10, 15],
    "min_samples_leaf": [1, 2, 4, 6],
}
NEIGHBOUR_GRID = {
    "n_neighbors": [3, 5, 7, 9, 11, 15],
    "weights": ["uniform", "distance"],
    "algorithm": ["auto", "ball_tree", "kd_tree"],
    "p": [1, 2],
}
BOOSTING_GRID = {
    "n_estimators": [50, 100, 200, 300],
    "learning_rate": [0.01, 0.05, 0.1, 0.2],
    "max_depth": [3, 4, 5, 6, 7],
    "min_samples_split": [2, 5, 10],
    "min_samples_leaf": [1, 2, 4],
    "subsample": [0.8, 0.9, 1.0],
}
KERNEL_GRID = {"C": [0.1, 1, 10, 100], "kernel": ["linear", "rbf"], "gamma": ["scale", "auto"]}
GRIDS: dict[str, dict[str, dict[str, list]]] = {
    "classification": {
        "RandomForestClassifier": FOREST_GRID,
        "LogisticRegression": {
            "C": [0.001, 0.01, 0.1, 1, 10, 100],
            "solver": ["liblinear", "lbfgs"],
            "penalty": ["l2"],
            "max_iter": [1000],
        },
        "SVC": KERNEL_GRID,
        "DecisionTreeClassifier": TREE_GRID | {"criterion": ["gini", "entropy"]},
        "KNeighborsClassifier": NEIGHBOUR_GRID,
        "GradientBoostingClassifier": BOOSTING_GRID,
    },
    "regression": {
        "RandomForestRegressor": FOREST_GRID,
        "LinearRegression": {"fit_intercept": [True, False], "copy_X": [True]},
        "SVR": KERNEL_GRID | {"epsilon": [0.01, 0.1, 0.2]},
        "DecisionTreeRegressor": TREE_GRID | {"criterion": ["squared_error", "friedman_mse"]},
        "KNeighborsRegressor": NEIGHBOUR_GRID,
        "GradientBoostingRegressor": BOOSTING_GRID,
    },
}


@dataclass(frozen=True)
class Shape:
    """Facts of the training matrix that parameter mappings need."""

    rows: int
    classes: int
    width: int
    variance: float


def grid(algorithm: str, task: str) -> dict[str, list]:
    if task not in GRIDS:
        raise ValueError(f"unsupported task type: {task}")
    if algorithm not in GRIDS[task]:
        raise ValueError(f"unsupported algorithm: {algorithm} for {task}; choose from {sorted(GRIDS[task])}")
    return GRIDS[task][algorithm]


def task_of(algorithm: str) -> str:
    """Task by the algorithm's name; each name belongs to one task."""
    for task, algorithms in GRIDS.items():
        if algorithm in algorithms:
            return task
    raise ValueError(f"unknown algorithm: {algorithm}")


def measure_shape(data: DataFrame, task: str, features: str = "features", label: str = "label") -> Shape:
    """Rows, classes, width and overall variance of the feature matrix, in one pass."""
    stats = Summarizer.metrics("mean", "variance", "count").summary(F.col(features)).alias("s")
    top = F.max(label) if task == "classification" else F.lit(0.0)
    row = data.agg(stats, top.alias("top")).first()
    s = row["s"]
    n, mean = s["count"], s["mean"].toArray()
    within = (s["variance"].toArray() * (n - 1) / n).mean() if n else 0.0
    return Shape(n, int(row["top"] or 0) + 1, len(mean), float(within + mean.var()))


def _smallest_leaf(params: dict) -> int:
    """Spark has no split minimum: half of it, rounded up, is the leaf size it implies."""
    return max(params.get("min_samples_leaf", 1), math.ceil(params.get("min_samples_split", 2) / 2))


def _depth(params: dict, default: int | None) -> int:
    depth = params.get("max_depth", default)
    return DEEPEST if depth is None else min(depth, DEEPEST)


def spark_params(algorithm: str, params: dict) -> dict:
    """The settings that reach Spark; grid points with equal settings are the same candidate."""
    kind = algorithm.replace("Classifier", "").replace("Regressor", "")
    regression = task_of(algorithm) == "regression"
    if kind == "RandomForest":
        subset = params.get("max_features", "all" if regression else "sqrt")
        return {
            "numTrees": params.get("n_estimators", 100),
            "maxDepth": _depth(params, None),
            "minInstancesPerNode": _smallest_leaf(params),
            "featureSubsetStrategy": subset,
            "bootstrap": params.get("bootstrap", True),
        }
    if kind == "DecisionTree":
        impurity = "variance" if regression else params.get("criterion", "gini")
        return {"maxDepth": _depth(params, None), "minInstancesPerNode": _smallest_leaf(params), "impurity": impurity}
    if kind == "GradientBoosting":
        return {
            "maxIter": params.get("n_estimators", 100),
            "stepSize": params.get("learning_rate", 0.1),
            "maxDepth": _depth(params, 3),
            "minInstancesPerNode": _smallest_leaf(params),
            "subsamplingRate": params.get("subsample", 1.0),
        }
    if kind == "KNeighbors":
        return {"k": params.get("n_neighbors", 5), "weights": params.get("weights", "uniform"), "p": params.get("p", 2)}
    if algorithm == "LogisticRegression":
        return {"C": params.get("C", 1.0), "maxIter": params.get("max_iter", 100)}
    if algorithm == "LinearRegression":
        return {"fitIntercept": params.get("fit_intercept", True)}
    out = {"C": params.get("C", 1.0), "kernel": params.get("kernel", "rbf")}
    if out["kernel"] == "rbf":
        out["gamma"] = params.get("gamma", "scale")
    if algorithm == "SVR":
        out["epsilon"] = params.get("epsilon", 0.1)
    return out


def _gamma(settings: dict, shape: Shape) -> float:
    gamma = settings["gamma"]
    if gamma == "scale":
        gamma = 1 / (shape.width * shape.variance) if shape.variance else 1.0
    elif gamma == "auto":
        gamma = 1 / shape.width
    return float(gamma)


def build(algorithm: str, params: dict, shape: Shape, seed: int = 42) -> Estimator:
    """A Spark estimator from ``features`` and ``label`` to ``prediction``."""
    task = task_of(algorithm)
    s = spark_params(algorithm, params)
    if algorithm == "RandomForestClassifier":
        return C.RandomForestClassifier(seed=seed, **s)
    if algorithm == "RandomForestRegressor":
        return R.RandomForestRegressor(seed=seed, **s)
    if algorithm == "DecisionTreeClassifier":
        return C.DecisionTreeClassifier(seed=seed, **s)
    if algorithm == "DecisionTreeRegressor":
        return R.DecisionTreeRegressor(seed=seed, **s)
    if algorithm == "GradientBoostingRegressor":
        return R.GBTRegressor(seed=seed, **s)
    if algorithm == "GradientBoostingClassifier":
        return C.GBTClassifier(seed=seed, **s) if shape.classes <= 2 else SoftmaxBoosting(classes=shape.classes, seed=seed, **s)
    if algorithm in ("KNeighborsClassifier", "KNeighborsRegressor"):
        return Neighbours(task=task, **s)
    if algorithm == "LinearRegression":
        return R.LinearRegression(regParam=0.0, solver="normal", fitIntercept=s["fitIntercept"])
    ridge = 1 / (s["C"] * max(shape.rows, 1))
    if algorithm == "LogisticRegression":
        return C.LogisticRegression(regParam=ridge, elasticNetParam=0.0, standardization=False, maxIter=s["maxIter"])
    if algorithm == "SVC":
        if s["kernel"] == "rbf":
            return KernelSVC(gamma=_gamma(s, shape), width=shape.width, classes=max(shape.classes, 2), regParam=ridge, seed=seed)
        margin = C.LinearSVC(regParam=ridge, standardization=False)
        return margin if shape.classes <= 2 else C.OneVsRest(classifier=margin)
    inner = EpsilonRegression(c=float(s["C"]), epsilon=float(s["epsilon"]))
    if s["kernel"] == "linear":
        return inner
    spread = FourierMap(inputCol="features", outputCol="fourier", gamma=_gamma(s, shape), width=shape.width, seed=seed)
    return Pipeline(stages=[spread, inner._set(featuresCol="fourier")])
