"""Queries over sources, sinks, estimators, tuning and scoring."""

from __future__ import annotations

import json

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.common import round_columns, rounded, sql_round, table
from catalog.structured import FOUR
from tabweave.automl import AutoTable, FittedTable
from tabweave.models.neighbours import Neighbours, NeighboursModel
from tabweave.models.registry import measure_shape
from tabweave.models.tuning import candidates, distinct_candidates, fit_default, search
from tabweave.operators import evaluate, pca
from tabweave.operators.folds import add_folds
from tabweave.operators.knn import average, knn_join, vote
from tabweave.operators.selection import assemble
from tabweave.plans.feature_plan import FeaturePlan, fit_plan
from tabweave.plans.roles import Roles
from tabweave.session import materialize, scratch_path, tasks_for
from tabweave.sources.tables import prediction_name, predictions_table, read_feature_cache, read_pair, write_feature_cache, write_table
from tabweave.streaming.scoring import read_stream, score_stream

QUERIES = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


# ---- flagship


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification report of a logistic regression on lineitem joined with its orders."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").drop("l_shipdate", "l_partkey", "l_suppkey")
    # joined once: the plan looks at the rows in some ten passes, the report in one more
    rows = materialize(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey"), "flagship-rows")
    run = AutoTable(
        "l_returnflag", "LogisticRegression", keep=("l_orderkey", "l_linenumber"), tune=False, feature_engineering=False
    )
    return run.fit(rows).report(rows)


@register()
def flagship_report(spark, sf_dir):
    return round_columns(flagship(spark, sf_dir), 6)


@register()
def engineered_report(spark, sf_dir):
    """The whole structured path: construction, pruning, encoding, selection, scaling, model."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", *FOUR, "l_linestatus", "l_shipdate", "l_returnflag")
    run = AutoTable("l_returnflag", "LogisticRegression", keep=("l_orderkey",), tune=False)
    return round_columns(run.fit(rows).report(rows), 6)


# ---- sources and sinks

LINE = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"]


@register(f"SELECT 'train' AS part, {', '.join(LINE)} FROM lineitem UNION ALL SELECT 'test', {', '.join(LINE)} FROM lineitem WHERE l_returnflag = 'R'")
def read_pair_csv(spark, sf_dir):
    folder = scratch_path(spark, "pair")
    lines = table(spark, sf_dir, "lineitem").select(*LINE)
    write_table(lines, f"{folder}/my_Train.csv")
    write_table(lines.where("l_returnflag = 'R'"), f"{folder}/my_test.csv")
    train, test = read_pair(spark, folder, kind="csv")
    both = train.select(F.lit("train").alias("part"), "*").unionByName(test.select(F.lit("test").alias("part"), "*"))
    return both.withColumn("l_orderkey", F.col("l_orderkey").cast("long"))


@register(f"SELECT {', '.join(LINE)} FROM lineitem")
def read_explicit_json(spark, sf_dir):
    path = scratch_path(spark, "lines") + ".json"
    lines = table(spark, sf_dir, "lineitem").select(*LINE)
    write_table(lines, path)
    return read_pair(spark, train=path, schema=lines.schema)[0]


def _scaled(spark, sf_dir) -> tuple[DataFrame, FeaturePlan, DataFrame]:
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    plan, made = fit_plan(df, Roles("l_returnflag", ("l_orderkey",)), "classification", feature_engineering=False)
    return df, plan, made


THREE = ["l_quantity", "l_discount", "l_tax"]
SCALED = (
    "WITH s AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in THREE)
    + " FROM lineitem), k AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT l_returnflag AS v FROM lineitem)) "
    + "SELECT l_orderkey, code::DOUBLE AS l_returnflag, "
    + ", ".join(f"{sql_round(f'({c} - m_{c}) / s_{c}', 6)} AS {c}" for c in THREE)
    + " FROM lineitem JOIN k ON l_returnflag = v, s"
)


@register(SCALED)
def feature_cache(spark, sf_dir):
    path = scratch_path(spark, "cache")
    write_feature_cache(_scaled(spark, sf_dir)[2], None, path)
    return round_columns(read_feature_cache(spark, path)[0], 6)


@register(SCALED)
def plan_roundtrip(spark, sf_dir):
    df, plan, _ = _scaled(spark, sf_dir)
    path = scratch_path(spark, "plan")
    plan.save(spark, path)
    return round_columns(FeaturePlan.load(spark, path).transform(df), 6)


PART_LINE = (
    "WITH s AS (SELECT min(p_size) AS low, max(p_size) - min(p_size) AS width FROM part), "
    "x AS (SELECT p_partkey, p_retailprice AS y, (p_size - low) / width AS x FROM part, s), "
    "r AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM x) "
)


def _part_run(spark, sf_dir) -> tuple[DataFrame, FittedTable]:
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    run = AutoTable("p_retailprice", "LinearRegression", keep=("p_partkey",), tune=False, feature_engineering=False)
    return df, run.fit(df)


@register(PART_LINE + f"SELECT p_partkey, {sql_round('a * x + b', 6)} AS prediction FROM x, r")
def linreg_one_feature(spark, sf_dir):
    df, fitted = _part_run(spark, sf_dir)
    return round_columns(fitted.transform(df), 6)


@register(PART_LINE + f"SELECT p_partkey, {sql_round('a * x + b', 6)} AS prediction FROM x, r")
def model_roundtrip(spark, sf_dir):
    df, fitted = _part_run(spark, sf_dir)
    path = scratch_path(spark, "model")
    fitted.save(spark, path)
    return round_columns(FittedTable.load(spark, path).transform(df.drop("p_retailprice")), 6)


@register(PART_LINE + f"SELECT p_partkey, {sql_round('a * x + b', 4)} AS prediction FROM x, r")
def predictions_sink(spark, sf_dir):
    df, fitted = _part_run(spark, sf_dir)
    path = scratch_path(spark, "results")
    fitted.save_results(df, path)
    back = spark.read.schema("p_partkey bigint, prediction double").option("header", True).csv(f"{path}/predictions")
    return round_columns(back, 4)


@register(
    PART_LINE
    + ", e AS (SELECT (y - a * x - b) * (y - a * x - b) AS e, y FROM x, r) "
    + "SELECT 'LinearRegression' AS algorithm, 'regression' AS task_type, 'p_retailprice' AS target_column, 'prediction' AS prediction_column, "
    + f"{sql_round('avg(e)', 4)} AS mse, {sql_round('1 - sum(e) / (var_pop(y) * count(*))', 6)} AS r2, 'p_size' AS features, 3::INT AS cv_folds FROM e"
)
def run_info(spark, sf_dir):
    df, fitted = _part_run(spark, sf_dir)
    fitted.evaluate(df)
    path = scratch_path(spark, "info")
    fitted.save_results(df, path)
    info = spark.read.json(f"{path}/training_info")
    metrics = F.from_json("metrics", "mse double, r2 double")
    return info.select(
        "algorithm",
        "task_type",
        "target_column",
        "prediction_column",
        rounded(metrics["mse"], 4).alias("mse"),
        rounded(metrics["r2"], 6).alias("r2"),
        F.array_join("feature_names", ",").alias("features"),
        F.col("cv_folds").cast("int").alias("cv_folds"),
    )


@register(
    "WITH x AS (SELECT event_id, value, hour(ts) AS h FROM events), s AS (SELECT min(h) AS low, max(h) - min(h) AS width FROM x), "
    "z AS (SELECT event_id, value AS y, (h - low) / width AS x FROM x, s), r AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM z) "
    f"SELECT event_id, {sql_round('a * x + b', 6)} AS prediction FROM z, r"
)
def stream_scoring(spark, sf_dir):
    """Fit on the events as a table, then score the same files as a stream."""
    df = table(spark, sf_dir, "events").select("event_id", F.hour("ts").alias("clock"), "value")
    run = AutoTable("value", "LinearRegression", keep=("event_id",), tune=False, feature_engineering=False)
    fitted = run.fit(df)
    stream = read_stream(spark, sf_dir, table(spark, sf_dir, "events").schema, pathGlobFilter="events.parquet")
    output = scratch_path(spark, "scored")
    rows = stream.select("event_id", F.hour("ts").alias("clock"))
    score_stream(fitted, rows, output, scratch_path(spark, "scored-checkpoint")).awaitTermination()
    return round_columns(spark.read.parquet(output), 6)


# ---- neighbours


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def _sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every vector asks, and every vector may answer."""
    queries = df.select(F.col("vec_id").alias("query_id"), F.col("v").alias("query_vector"))
    train = df.select(
        F.col("vec_id").alias("train_id"), F.col("v").alias("train_vector"), F.col("label").cast("double").alias("label")
    )
    return queries, train


def sql_neighbours(k: int, p: int) -> str:
    gap = "list_distance(a.v, b.v)" if p == 2 else "list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))"
    return (
        "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), "
        f"d AS (SELECT a.vec_id AS query_id, b.vec_id AS train_id, b.label, {gap} AS distance FROM e a, e b), "
        "n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, train_id) AS rank FROM d "
        f"QUALIFY rank <= {k})"
    )


@register(sql_neighbours(5, 2) + f" SELECT query_id, train_id, {sql_round('distance', 6)} AS distance, rank::INT AS rank FROM n")
def knn_join_cells(spark, sf_dir):
    """Several cells and blocks, so that pruning and merging are exercised."""
    queries, train = _sides(_vectors(spark, sf_dir))
    found = knn_join(queries, train, 5, cells=16, train_block=64, query_block=64)
    return round_columns(found.select("query_id", "train_id", "distance", "rank"), 6)


@register(sql_neighbours(7, 1) + f" SELECT query_id, train_id, {sql_round('distance', 6)} AS distance, rank::INT AS rank FROM n")
def knn_join_manhattan(spark, sf_dir):
    queries, train = _sides(_vectors(spark, sf_dir))
    found = knn_join(queries, train, 7, p=1, cells=4)
    return round_columns(found.select("query_id", "train_id", "distance", "rank"), 6)


@register(
    sql_neighbours(5, 2)
    + ", v AS (SELECT query_id, label, count(*) AS n FROM n GROUP BY ALL) "
    + "SELECT query_id, label::DOUBLE AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) = 1"
)
def knn_classify(spark, sf_dir):
    return vote(knn_join(*_sides(_vectors(spark, sf_dir)), 5))


@register(sql_neighbours(5, 2) + f" SELECT query_id, {sql_round('avg(label)', 6)} AS prediction FROM n GROUP BY 1")
def knn_regress(spark, sf_dir):
    return round_columns(average(knn_join(*_sides(_vectors(spark, sf_dir)), 5)), 6)


@register("SELECT vec_id, label::DOUBLE AS prediction FROM embeddings")
def knn_estimator_weighted(spark, sf_dir):
    """Distance weights on the training rows: each row's own distance of 0 silences the rest."""
    df = _vectors(spark, sf_dir)
    names = [f"e{i}" for i in range(64)]
    wide = df.select("vec_id", F.col("label").cast("double").alias("label"), *[F.col("v")[i].alias(n) for i, n in enumerate(names)])
    data = assemble(wide, names, ["vec_id", "label"])
    model = Neighbours(k=3, weights="distance").fit(data)
    return model.transform(data).select("vec_id", "prediction")


# ---- reduction


@register()
def pca_explained(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    names = [f"e{i}" for i in range(64)]
    wide = df.select(*[F.col("v")[i].alias(n) for i, n in enumerate(names)])
    spec, model = pca.fit_pca(wide, names)
    rows = [(i + 1, share) for i, share in enumerate(spec["shares"])]
    return round_columns(spark.createDataFrame(rows, "component int, share double"), 9)


@register(
    "WITH e AS (SELECT unnest(range(1, 65)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings), v AS (SELECT i, var_samp(x) AS v FROM e GROUP BY 1) "
    f"SELECT {sql_round('sum(v)', 6)} AS total_variance FROM v"
)
def pca_total_variance(spark, sf_dir):
    """All components together carry the variance of the columns."""
    df = _vectors(spark, sf_dir)
    names = [f"e{i}" for i in range(64)]
    wide = df.select(*[F.col("v")[i].alias(n) for i, n in enumerate(names)])
    spec, model = pca.fit_pca(wide, names, variance=1.0)
    made = pca.apply_pca(wide, spec, model)
    total = sum((F.var_samp(c) for c in made.columns[1:]), F.var_samp(made.columns[0]))
    return round_columns(made.agg(total.alias("total_variance")), 6)


# ---- the estimators


# The label is a rule on one feature among five, so a sound fit predicts it on every row.
RULE = "CASE WHEN l_linenumber <= 3 THEN 1.0 ELSE 0.0 END"
STEP = "CASE WHEN l_linenumber <= 2 THEN 10.0 WHEN l_linenumber <= 5 THEN 20.0 ELSE 35.0 END"
PLANE = "2 * l_quantity - 3 * l_tax + l_linenumber + 7"
FIVE = ["l_linenumber", *FOUR]


def _rows(spark, sf_dir, label: str) -> DataFrame:
    wide = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("line"), F.expr(label).cast("double").alias("label"), *FIVE
    )
    wide = wide.withColumn("l_extendedprice", F.col("l_extendedprice") / 1000)
    tasks = max(spark.sparkContext.defaultParallelism, tasks_for(wide.count(), len(FIVE)))
    return materialize(assemble(wide, FIVE, ["l_orderkey", "line", "label"]).repartition(tasks, "l_orderkey"), "model-rows")


def _predicted(data: DataFrame, algorithm: str, task: str, params: dict) -> DataFrame:
    found = fit_default(data, algorithm, measure_shape(data, task), params=params)
    return found.model.transform(data).select("l_orderkey", "line", "label", "prediction")


def _exact(label: str) -> str:
    return f"SELECT l_orderkey, l_linenumber AS line, {sql_round(f'({label})::DOUBLE', 6)} AS label, {sql_round(f'({label})::DOUBLE', 6)} AS prediction FROM lineitem"


ESTIMATORS = {
    "RandomForestClassifier": ("classification", RULE, {"n_estimators": 20, "max_depth": 6}),
    "LogisticRegression": ("classification", RULE, {"C": 100}),
    "SVC": ("classification", RULE, {"kernel": "linear", "C": 1}),
    "DecisionTreeClassifier": ("classification", RULE, {"max_depth": 5}),
    "GradientBoostingClassifier": ("classification", RULE, {"n_estimators": 5}),
    "RandomForestRegressor": ("regression", STEP, {"n_estimators": 10, "max_depth": 5}),
    "LinearRegression": ("regression", PLANE, {}),
    "DecisionTreeRegressor": ("regression", STEP, {"max_depth": 5}),
    "GradientBoostingRegressor": ("regression", STEP, {"n_estimators": 5}),
}


def _register_estimator(algorithm: str, task: str, label: str, params: dict) -> None:
    def run(spark, sf_dir):
        return round_columns(_predicted(_rows(spark, sf_dir, label), algorithm, task, params), 6)

    run.__name__ = f"fit_predict_{algorithm.lower()}"
    register(_exact(label))(run)


for _name, _how in ESTIMATORS.items():
    _register_estimator(_name, *_how)


@register("SELECT l_orderkey, l_linenumber AS line, 1::INT AS near FROM lineitem")
def fit_predict_svr(spark, sf_dir):
    """The plane is found to within the tube, on every row."""
    made = _predicted(_rows(spark, sf_dir, PLANE), "SVR", "regression", {"kernel": "linear", "C": 100})
    near = F.abs(F.col("label") - F.col("prediction")) < 0.5
    return made.select("l_orderkey", "line", near.cast("int").alias("near"))


@register()
def fit_predict_svc_rbf(spark, sf_dir):
    return _predicted(_rows(spark, sf_dir, RULE), "SVC", "classification", {"kernel": "rbf"})


@register()
def fit_predict_gbt_multiclass(spark, sf_dir):
    """Ten classes of embeddings by boosting with the softmax loss."""
    df = _vectors(spark, sf_dir)
    names = [f"e{i}" for i in range(64)]
    wide = df.select("vec_id", F.col("label").cast("double").alias("label"), *[F.col("v")[i].alias(n) for i, n in enumerate(names)])
    data = materialize(assemble(wide, names, ["vec_id", "label"]), "embedding-rows")
    found = fit_default(data, "GradientBoostingClassifier", measure_shape(data, "classification"), params={"n_estimators": 2})
    return found.model.transform(data).select("vec_id", "label", "prediction")


THREE = "CASE WHEN p_size % 10 < 3 THEN 0 WHEN p_partkey % 7 < 4 THEN 1 ELSE 2 END"


@register(f"SELECT p_partkey, ({THREE})::DOUBLE AS label, ({THREE})::DOUBLE AS prediction FROM part")
def fit_predict_gbt_three_classes(spark, sf_dir):
    """A planted rule of two columns with three classes."""
    df = table(spark, sf_dir, "part").select(
        "p_partkey", F.expr(THREE).cast("double").alias("label"), (F.col("p_size") % 10).alias("s"), (F.col("p_partkey") % 7).alias("t"), (F.col("p_partkey") % 3).alias("u")
    )
    data = materialize(assemble(df, ["s", "t", "u"], ["p_partkey", "label"]), "part-rows")
    found = fit_default(data, "GradientBoostingClassifier", measure_shape(data, "classification"), params={"n_estimators": 3})
    return found.model.transform(data).select("p_partkey", "label", "prediction")


# ---- tuning


def _tried(spark, found) -> DataFrame:
    rows = [(json.dumps(p, sort_keys=True), float(s)) for p, s in found.tried]
    return round_columns(spark.createDataFrame(rows, "params string, score double"), 6)


def _folded_part(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("label"), "p_size", (F.col("p_partkey") % 1000).alias("m"))
    data = assemble(df, ["p_size", "m"], ["p_partkey", "label"])
    return materialize(add_folds(data, "p_partkey", 3), "folds")


# One fold's R^2: the line is fitted on the other folds. Without an intercept the slope is sum(xy)/sum(xx).
FOLD_FIT = """
WITH f AS (SELECT o_totalprice AS y, o_custkey::DOUBLE AS x, ntile(3) OVER (ORDER BY o_orderkey) - 1 AS fold FROM orders),
k AS (SELECT unnest([0, 1, 2]) AS k),
c AS (SELECT k, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, sum(x * y) / sum(x * x) AS o FROM f, k WHERE fold <> k GROUP BY k),
s AS (SELECT k, 1 - sum((y - a * x - b) * (y - a * x - b)) / (var_pop(y) * count(*)) AS with_b,
  1 - sum((y - o * x) * (y - o * x)) / (var_pop(y) * count(*)) AS without FROM f JOIN c ON fold = k GROUP BY k)
"""


@register(
    FOLD_FIT
    + """SELECT '{"copy_X": true, "fit_intercept": true}' AS params, """
    + sql_round("avg(with_b)", 6)
    + """ AS score FROM s UNION ALL SELECT '{"copy_X": true, "fit_intercept": false}', """
    + sql_round("avg(without)", 6)
    + " FROM s"
)
def grid_search(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("label"), "o_custkey")
    data = materialize(add_folds(assemble(df, ["o_custkey"], ["o_orderkey", "label"]), "o_orderkey", 3), "folds")
    kind, points = candidates("LinearRegression", "regression", 3)
    assert kind == "grid"
    shape = measure_shape(data, "regression")
    return _tried(spark, search(data, "LinearRegression", "regression", distinct_candidates("LinearRegression", points), shape, 3))


@register()
def random_search(spark, sf_dir):
    data = _folded_part(spark, sf_dir)
    kind, points = candidates("DecisionTreeRegressor", "regression", 3)
    assert kind == "random"
    shape = measure_shape(data, "regression")
    points = distinct_candidates("DecisionTreeRegressor", points)
    return _tried(spark, search(data, "DecisionTreeRegressor", "regression", points, shape, 3, parallelism=8))


# ---- text to predictions


@register()
def text_quality_predictions(spark, sf_dir):
    """Documents joined with their labels, text features, logistic regression on quality."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    rows = docs.join(labels, "doc_id")
    run = AutoTable(
        "quality", "LogisticRegression", keep=("doc_id",), text=("text",), dataset_type="mixed", tune=False,
        feature_engineering=False, max_features=300,
    )
    fitted = run.fit(rows)
    return fitted.transform(docs)
