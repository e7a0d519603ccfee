import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabweave import session
from tabweave.models import registry, tuning
from tabweave.models.neighbours import Neighbours, NeighboursModel
from tabweave.operators import kernel_svc, knn, pca, svr
from tabweave.operators.fourier import FourierMap, fourier_weights
from tabweave.operators.kernel_svc import KernelSVCModel
from tabweave.operators.knn import knn_join
from tabweave.operators.svr import EpsilonRegression, EpsilonRegressionModel
from tabweave.operators.topics import add_projection, fit_svd
from tabweave.session import scratch_path


def brute(queries, train, k, p):
    gap = np.abs(queries[:, None] - train[None]) ** p
    gap = gap.sum(axis=2) ** (1 / p)
    order = np.lexsort((np.broadcast_to(np.arange(len(train)), gap.shape), gap), axis=1)[:, :k]
    return order, np.take_along_axis(gap, order, axis=1)


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("cells", [1, 9])
def test_knn_join_equals_brute_force_with_copies(spark, p, cells):
    draw = np.random.RandomState(0)
    train = np.vstack([draw.normal(size=(120, 3)), np.repeat([[0.5, 0.5, 0.5]], 60, axis=0)])
    queries = np.vstack([draw.normal(size=(40, 3)), [[0.5, 0.5, 0.5]]])
    t = spark.createDataFrame([(i, v.tolist(), float(i % 3)) for i, v in enumerate(train)], "train_id long, train_vector array<double>, label double")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, query_vector array<double>")
    rows = knn_join(q, t, 6, p, cells=cells, train_block=16, query_block=8).orderBy("query_id", "rank").toPandas()
    order, gaps = brute(queries, train, 6, p)
    assert rows["train_id"].tolist() == order.ravel().tolist()
    np.testing.assert_allclose(rows["distance"], gaps.ravel(), atol=1e-12)
    assert (rows["label"] == rows["train_id"] % 3).all()


def test_knn_with_fewer_rows_than_k(spark):
    t = spark.createDataFrame([(0, [0.0], 1.0), (1, [2.0], 3.0)], "train_id long, train_vector array<double>, label double")
    q = spark.createDataFrame([(5, [0.5])], "query_id long, query_vector array<double>")
    assert knn_join(q, t, 9).count() == 2


def labelled(spark, n=300, seed=4):
    draw = np.random.RandomState(seed)
    x = draw.normal(size=(n, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(float)
    return spark.createDataFrame([(Vectors.dense(v), float(c)) for v, c in zip(x, y)], ["features", "label"])


def valued(spark, n=300, seed=5):
    draw = np.random.RandomState(seed)
    x = draw.normal(size=(n, 3))
    y = x @ [2.0, -1.0, 0.5] + 3
    return spark.createDataFrame([(Vectors.dense(v), float(c)) for v, c in zip(x, y)], ["features", "label"])


@pytest.mark.parametrize("algorithm", sorted(registry.GRIDS["classification"]))
def test_classifiers_beat_the_majority(spark, algorithm):
    data = labelled(spark).persist()
    quick = {"RandomForestClassifier": {"n_estimators": 5, "max_depth": 4}, "GradientBoostingClassifier": {"n_estimators": 3}}
    shape = registry.measure_shape(data, "classification")
    found = tuning.fit_default(data, algorithm, shape, params=quick.get(algorithm, {}))
    assert tuning.evaluator("classification").evaluate(found.model.transform(data)) > 0.8


@pytest.mark.parametrize("algorithm", sorted(registry.GRIDS["regression"]))
def test_regressors_explain_a_plane(spark, algorithm):
    data = valued(spark).persist()
    quick = {"RandomForestRegressor": {"n_estimators": 5, "max_depth": 6}, "GradientBoostingRegressor": {"n_estimators": 8}}
    params = quick.get(algorithm, {"kernel": "linear"} if algorithm == "SVR" else {})
    shape = registry.measure_shape(data, "regression")
    found = tuning.fit_default(data, algorithm, shape, params=params)
    assert tuning.evaluator("regression").evaluate(found.model.transform(data)) > 0.6


def test_epsilon_regression_finds_the_plane_and_never_climbs(spark):
    model = EpsilonRegression(c=100.0, epsilon=0.01).fit(valued(spark))
    np.testing.assert_allclose(model.getOrDefault(model.weights), [2.0, -1.0, 0.5, 3.0], atol=0.05)
    assert all(a >= b for a, b in zip(model.history, model.history[1:]))
    path = scratch_path(spark, "svr")
    model.save(path)
    back = EpsilonRegressionModel.load(path)
    assert back.getOrDefault(back.weights) == model.getOrDefault(model.weights)


def test_epsilon_regression_reads_blocks_that_hold_every_row(spark, monkeypatch):
    monkeypatch.setattr(svr, "BLOCK_BYTES", 8 * 4 * 7)
    rows = spark.range(0, 100, 1, 3).selectExpr("array(id * 0.5, id * 1.0, -id * 2.0) AS x", "id * 3.0 AS y")
    blocks = svr.packed(rows.selectExpr("CAST(x AS array<double>) AS x", "CAST(y AS double) AS y")).collect()
    assert max(b["n"] for b in blocks) == 7 and {b["width"] for b in blocks} == {3} and len(blocks) < 20
    found = []
    for b in blocks:
        numbers = np.frombuffer(b["block"])
        found += [(*x, y) for x, y in zip(numbers[: 3 * b["n"]].reshape(-1, 3).tolist(), numbers[3 * b["n"] :].tolist())]
    assert sorted(found) == [(i * 0.5, i * 1.0, -i * 2.0, i * 3.0) for i in range(100)]


def test_neighbour_model_round_trip(spark):
    data = labelled(spark, 60)
    model = Neighbours(k=3, weights="distance").fit(data)
    path = scratch_path(spark, "knn")
    model.save(path)
    back = NeighboursModel.load(path)
    out = back.transform(data)
    assert out.where("label = prediction").count() == 60 and back.getOrDefault(back.k) == 3


def test_fourier_inner_products_approximate_the_kernel(spark):
    data = labelled(spark, 20)
    gamma = 0.4
    made = FourierMap(inputCol="features", outputCol="z", gamma=gamma, width=3, size=4000, seed=1).transform(data)
    rows = made.select("features", "z").collect()
    x = np.array([r["features"].toArray() for r in rows])
    z = np.array([r["z"].toArray() for r in rows])
    kernel = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - kernel).max() < 0.1


def test_search_strategy_follows_the_grid_size():
    kinds = {a: tuning.candidates(a, t, 3)[0] for t, g in registry.GRIDS.items() for a in g}
    random = {"RandomForestClassifier", "DecisionTreeClassifier", "GradientBoostingClassifier", "RandomForestRegressor", "DecisionTreeRegressor", "GradientBoostingRegressor"}
    assert {a for a, k in kinds.items() if k == "random"} == random
    assert len(tuning.candidates("RandomForestClassifier", "classification", 3)[1]) == 50
    assert tuning.candidates("SVC", "classification", 3, 1) == tuning.candidates("SVC", "classification", 3, 2)
    first, second = (tuning.candidates("DecisionTreeRegressor", "regression", 3, 7) for _ in range(2))
    assert first == second
    points = tuning.candidates("LogisticRegression", "classification", 3)[1]
    assert len(points) == 12 and len(tuning.distinct_candidates("LogisticRegression", points)) == 6


def test_search_refits_the_best_point(spark):
    data = valued(spark).withColumn("fold", (F.xxhash64("label") % 3 + 3) % 3).withColumn("fold", F.col("fold").cast("int"))
    shape = registry.measure_shape(data, "regression")
    points = [{"fit_intercept": False}, {"fit_intercept": True}]
    found = tuning.search(data, "LinearRegression", "regression", points, shape, 3)
    assert found.params == {"fit_intercept": True} and found.score > 0.999 and len(found.tried) == 2


def test_parameter_mapping_folds_missing_counterparts():
    assert registry.spark_params("DecisionTreeClassifier", {"max_depth": None, "min_samples_split": 15, "min_samples_leaf": 2}) == {
        "maxDepth": 30, "minInstancesPerNode": 8, "impurity": "gini"
    }
    with pytest.raises(ValueError, match="unsupported algorithm"):
        registry.grid("SVR", "classification")


def test_pca_equals_numpy_and_centres(spark):
    draw = np.random.RandomState(2)
    x = draw.normal(size=(80, 4)) @ np.diag([5, 2, 1, 0.1]) + 7
    df = spark.createDataFrame(x.tolist(), ["a", "b", "c", "d"])
    spec, model = pca.fit_pca(df, ["a", "b", "c", "d"], 0.95)
    centred = x - x.mean(axis=0)
    values = np.linalg.svd(centred, compute_uv=False) ** 2
    k = int(np.searchsorted(np.cumsum(values / values.sum()), 0.95, side="right")) + 1
    assert len(spec["shares"]) == k
    out = np.array([list(r) for r in pca.apply_pca(df, spec, model).collect()])
    np.testing.assert_allclose(out.mean(axis=0), 0, atol=1e-9)
    np.testing.assert_allclose(out.var(axis=0), values[:k] / len(x), rtol=1e-9)


def test_svd_equals_numpy(spark):
    draw = np.random.RandomState(6)
    x = np.where(draw.uniform(size=(50, 12)) < 0.3, draw.uniform(size=(50, 12)), 0.0)
    rows = [(i, Vectors.sparse(12, [(j, v) for j, v in enumerate(r) if v])) for i, r in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, ["i", "v"])
    basis, singular = fit_svd(df, "v", 12, 5)
    np.testing.assert_allclose(singular, np.linalg.svd(x, compute_uv=False)[:5], rtol=1e-9)
    out = {r["i"]: r["z"] for r in add_projection(df, "v", basis, "z").collect()}
    np.testing.assert_allclose([out[i] for i in range(50)], x @ basis, atol=1e-9)


@pytest.mark.parametrize("p", [1, 2])
def test_knn_parcels_send_each_row_a_few_times_whatever_the_block_sizes(spark, p, monkeypatch):
    draw = np.random.RandomState(3)
    train = draw.normal(size=(600, 8))
    train[300:320] = train[0]
    t = spark.createDataFrame([(i, v.tolist(), float(i % 3)) for i, v in enumerate(train)], "train_id long, train_vector array<double>, label double")
    q = t.selectExpr("train_id AS query_id", "train_vector AS query_vector")
    sent = []
    parcels = knn._parcels

    def counted(*args):
        sides = parcels(*args)
        sent.append(sum(side.count() for side in sides))
        return sides

    monkeypatch.setattr(knn, "_parcels", counted)
    order, gaps = brute(train, train, 5, p)
    # blocks of 8 on 8 cells were 75 copies of each query and 75 of each row
    for parcel, most in ((None, 2 * 600), (100, 2 * 600 * 9)):
        rows = knn_join(q, t, 5, p, cells=8, train_block=8, query_block=8, parcel=parcel).orderBy("query_id", "rank").toPandas()
        assert rows["train_id"].tolist() == order.ravel().tolist()
        np.testing.assert_allclose(rows["distance"], gaps.ravel(), atol=1e-12)
        assert sent[-1] <= most


def test_knn_screen_of_steps_misses_no_neighbour():
    draw = np.random.RandomState(5)
    for width, scale in ((2, 1e-6), (64, 0.1), (64, 1e9), (1500, 1.0)):
        left, right = scale * draw.normal(size=(30, width)), scale * draw.normal(size=(200, width))
        right[50:60] = right[0]
        everything = np.ones((30, 1), bool)
        for tile in ((7, 9), (256, 2048)):
            found = list(knn._nearest(left, everything, right, np.zeros(200, int), np.arange(200), 6, 1, tile))
            order, gaps = brute(left, right, 6, 1)
            assert np.concatenate([f[1] for f in found]).tolist() == order.ravel().tolist()
            np.testing.assert_allclose(np.concatenate([f[2] for f in found]), gaps.ravel(), rtol=1e-12)


def test_a_task_of_a_tree_fit_has_no_more_rows_in_a_larger_table(spark, monkeypatch):
    data = labelled(spark).coalesce(2)
    for rows in (36_000_000, 216_000_000):
        shape = registry.Shape(rows, 2, 5, 1.0)
        for algorithm in ("RandomForestClassifier", "DecisionTreeRegressor", "GradientBoostingClassifier"):
            assert rows / tuning.dealt(data, algorithm, shape).rdd.getNumPartitions() < 300_000
        assert tuning.dealt(data, "LogisticRegression", shape).rdd.getNumPartitions() == 2
    assert tuning.dealt(data, "RandomForestClassifier", registry.measure_shape(data, "classification")) is data
    # the rows that a fit gets are dealt
    fitted = []
    monkeypatch.setattr(session, "TASK_BYTES", 10_000)
    own = RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, rows: fitted.append(rows.rdd.getNumPartitions()) or own(self, rows))
    found = tuning.fit_default(data, "RandomForestClassifier", registry.measure_shape(data, "classification"), params={"n_estimators": 5, "max_depth": 4})
    assert fitted == [7]
    assert tuning.evaluator("classification").evaluate(found.model.transform(data)) > 0.8


@pytest.mark.parametrize("classes", [2, 3])
def test_kernel_classifier_equals_spark_on_stored_features(spark, tmp_path, classes):
    draw = np.random.RandomState(6)
    x = draw.normal(size=(400, 3))
    far = np.sqrt((x * x).sum(axis=1))
    y = np.digitize(far, [1.5] if classes == 2 else [1.2, 1.9]).astype(float)
    data = spark.createDataFrame([(Vectors.dense(v), float(c)) for v, c in zip(x, y)], ["features", "label"]).persist()
    shape = registry.measure_shape(data, "classification")
    model = registry.build("SVC", {"kernel": "rbf", "C": 1}, shape).fit(data)
    made = [r["prediction"] for r in model.transform(data).collect()]
    spread = FourierMap(inputCol="features", outputCol="fourier", gamma=1 / (shape.width * shape.variance), width=3, seed=42)
    margin = LinearSVC(featuresCol="fourier", regParam=1 / 400, standardization=False)
    plain = Pipeline(stages=[spread, margin if classes == 2 else OneVsRest(classifier=margin, featuresCol="fourier")]).fit(data)
    assert np.mean(np.array(made) == [r["prediction"] for r in plain.transform(data).collect()]) >= 0.97
    assert np.mean(np.array(made) == y) > 0.9
    model.write().overwrite().save(str(tmp_path / "svc"))
    back = KernelSVCModel.load(str(tmp_path / "svc"))
    assert [r["prediction"] for r in back.transform(data).collect()] == made


def test_kernel_classifier_keeps_the_narrow_rows_only(spark):
    data = labelled(spark, 2_000)
    stored = kernel_svc.packed(data, "features", "label")
    held = stored.agg(F.sum(F.length("x") + F.length("y")).alias("n")).first()["n"]
    # three features and a label of eight bytes; the Fourier features that were stored are 256
    assert held == 2_000 * 4 * 8
    with_stage = registry.build("SVC", {"kernel": "rbf"}, registry.measure_shape(data, "classification"))
    assert isinstance(with_stage, kernel_svc.KernelSVC)


@pytest.mark.parametrize("shape, spread", [("near", 1.0), ("far", 1e6)])
def test_kernel_classifier_makes_only_the_features_that_others_do_not_follow_from(shape, spread):
    """Of neighbouring rows most features follow from a few; rows of many directions keep all, and so do rows that are not finite."""
    draw = np.random.RandomState(4)
    x = draw.normal(size=(3_000, 3)) * [0.1, 0.1, 0.1 * spread]
    y = (x[:, 0] > 0).astype(float)
    weights, shift = fourier_weights(42, 0.5, 3, 256)
    full = kernel_svc.fourier(x, weights, shift)
    kept, mix, sums = kernel_svc.condensed(x, y, weights, shift)
    assert (len(kept) < 128) == (shape == "near")
    made = np.vstack([m.copy() for m in kernel_svc.half_cosines(x, weights[:, kept], shift[kept])])
    found = (2 * made - 1) * np.sqrt(2 / 256)
    assert np.abs((found @ mix if shape == "near" else found) - full).max() < 1e-5
    assert np.allclose(sums, np.concatenate([[3_000], full.sum(axis=0), (full**2).sum(axis=0), [y.sum()]]))
    x[5, 1] = np.nan
    kept, mix, sums = kernel_svc.condensed(x, y, weights, shift)
    assert len(kept) == 256 and not len(mix) and np.isnan(sums).any()


def test_neighbourhoods_hold_every_row_once():
    x = np.random.RandomState(1).randint(0, 3, size=(1_000, 2)).astype(float)
    parts = list(kernel_svc.neighbourhoods(x, 64))
    assert max(map(len, parts)) <= 64 and sorted(np.concatenate(parts)) == list(range(1_000))


def test_kernel_steps_are_tried_together(monkeypatch):
    """Steps, ends and the number of lengths looked at stay the same; a pass takes several of them."""
    draw = np.random.RandomState(2)
    a, side = draw.normal(size=(300, 8)), np.sign(draw.normal(size=300))

    def hinge(w):
        lost = 1 - side * (a @ w)
        return np.maximum(lost, 0).mean() + w @ w / 600, -((side * (lost > 0)) @ a) / 300 + w / 300

    ends, passes = [], []
    for ahead in (1, 3):
        calls = []
        monkeypatch.setattr(kernel_svc, "AHEAD", ahead)
        ends.append(kernel_svc.minimise(lambda points: calls.append(len(points)) or [hinge(p) for p in points], np.zeros(8), 60, 1e-9))
        passes.append(len(calls))
    assert np.array_equal(*ends) and passes[1] < 0.7 * passes[0]
