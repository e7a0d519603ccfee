import pytest
from pyspark.sql import functions as F

from catalog import models
from tabweave import AutoTable, FeaturePlan, FittedTable, Roles, fit_plan
from tabweave import automl
from tabweave.__main__ import run
from tabweave.session import materialize, scratch_path
from tabweave.sources.tables import prediction_name, read_feature_cache, read_pair, read_table, write_feature_cache, write_table
from tabweave.streaming.scoring import read_stream, score_stream


def people(spark, n=400):
    return spark.range(n).selectExpr(
        "id",
        "if(id % 11 = 0, null, double(id * 7 % 50)) as age",
        "double(id * 13 % 31) + 1 as fare",
        "if(id % 2 = 0, 'm', 'f') as sex",
        "concat('t', id % 17) as ticket",
        "cast(date_add(date'2024-01-01', int(id % 90)) as string) as join_date",
        "5.0D as fixed",
        "if((id * 7 % 50) + (id % 2) * 10 > 30, 'yes', 'no') as survived",
    )


@pytest.fixture(scope="module")
def fitted(spark):
    return AutoTable("survived", "LogisticRegression", keep=("id",), tune=False, exact=True).fit(people(spark))


def test_replay_equals_the_fit(spark):
    df = people(spark)
    plan, made = fit_plan(df, Roles("survived", ("id",)), "classification", exact=True)
    again = plan.transform(df)
    assert made.columns == again.columns
    left, right = (sorted(map(tuple, x.collect()), key=lambda r: r[made.columns.index("id")]) for x in (made, again))
    for a, b in zip(left, right):
        assert a == pytest.approx(b)
    path = scratch_path(spark, "plan")
    plan.save(spark, path)
    back = FeaturePlan.load(spark, path)
    assert back.steps == plan.steps and back.transform(df).columns == made.columns


def test_plan_decisions(fitted):
    steps = fitted.plan.steps
    assert steps["reasons"]["fixed"] == "constant" and steps["classes"] == ["no", "yes"]
    assert any(c.startswith("join_date_") for c in fitted.plan.features)
    assert "id" not in fitted.plan.features and not any("survived" in c for c in fitted.plan.features)


def test_scoring_takes_nulls_unseen_values_and_no_target(spark, fitted):
    odd = people(spark).drop("survived").where("id < 3").withColumn("sex", F.lit("other")).withColumn("fare", F.lit(None).cast("double"))
    out = fitted.transform(odd)
    assert out.columns == ["id", "prediction"] and out.count() == 3
    assert {r["prediction"] for r in out.collect()} <= {"yes", "no"}
    assert fitted.evaluate(odd) == {}


def test_quality_report_and_round_trip(spark, fitted):
    df = people(spark)
    assert fitted.evaluate(df)["accuracy"] > 0.8
    assert {r["class"] for r in fitted.report(df).collect()} == {"yes", "no", "accuracy", "macro avg", "weighted avg"}
    path = scratch_path(spark, "run")
    fitted.save(spark, path)
    back = FittedTable.load(spark, path)
    assert sorted(back.transform(df).collect()) == sorted(fitted.transform(df).collect())


def test_stream_gives_the_batch_predictions(spark, fitted):
    folder, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    df = people(spark).drop("survived")
    df.repartition(3).write.parquet(folder)
    stream = read_stream(spark, folder, df.schema, maxFilesPerTrigger=1)
    score_stream(fitted, stream, out, scratch_path(spark, "check")).awaitTermination()
    assert sorted(spark.read.parquet(out).collect()) == sorted(fitted.transform(df).collect())


def test_neighbour_stream_runs_per_batch(spark):
    df = spark.range(60).selectExpr("id", "double(id % 9) a", "double(id * 5 % 13) b", "if(id % 9 > 4, 'x', 'z') as y")
    model = AutoTable("y", "KNeighborsClassifier", keep=("id",), tune=False, feature_engineering=False).fit(df)
    folder, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    df.drop("y").write.parquet(folder)
    score_stream(model, read_stream(spark, folder, df.drop("y").schema), out, scratch_path(spark, "check")).awaitTermination()
    assert spark.read.parquet(out).count() == 60


def test_regression_with_tuning(spark):
    df = spark.range(200).selectExpr("id", "double(id % 20) a", "double(id * 3 % 7) b", "id % 20 * 2.5D + id * 3 % 7 as price")
    out = AutoTable("price", "LinearRegression", keep=("id",), feature_engineering=False).fit(df)
    assert out.search == "grid" and out.params["fit_intercept"] in (True, False) and out.baseline["score"] > 0.99
    assert out.evaluate(df)["r2"] > 0.99


def test_mixed_text_and_table(spark):
    df = spark.range(80).selectExpr(
        "id", "double(id % 7) n", "if(id % 2 = 0, 'good great day outside', 'bad awful night inside') || ' number ' || id % 5 as body", "int(id % 2) y"
    )
    for kind in ("mixed", "text"):
        run_ = AutoTable("y", "LogisticRegression", keep=("id",), dataset_type=kind, tune=False, feature_engineering=False, max_features=50)
        fitted = run_.fit(df)
        assert fitted.text_plan.columns == ["body"] and fitted.evaluate(df)["accuracy"] == 1.0
    path = scratch_path(spark, "mixed")
    fitted.save(spark, path)
    assert sorted(FittedTable.load(spark, path).transform(df).collect()) == sorted(fitted.transform(df).collect())


def test_switches_take_effect(spark):
    df = people(spark)
    plain, _ = fit_plan(df, Roles("survived", ("id",)), "classification", feature_engineering=False, encode_categorical=False)
    assert set(plain.features) == {"age", "fare"}
    raw, made = fit_plan(df.select("id", "age", "fare", "survived"), Roles("survived", ("id",)), "classification", False, False)
    assert "missing" not in raw.steps and made.where("age is null").count() > 0


def test_bad_requests(spark):
    with pytest.raises(ValueError, match="not found"):
        fit_plan(people(spark), Roles("nope"), "classification")
    with pytest.raises(ValueError, match="unsupported algorithm"):
        AutoTable("y", "SVR", task="classification")
    with pytest.raises(TypeError, match="regression needs numbers"):
        fit_plan(people(spark), Roles("survived"), "regression")


def test_prediction_column_name():
    assert prediction_name(("id", "y"), "classification", "y") == "y"
    assert prediction_name(("id",), "classification", "y") == prediction_name(("y",), "regression", "y") == "prediction"


def test_pair_discovery_and_cache(spark):
    folder = scratch_path(spark, "pair")
    with_comma = spark.createDataFrame([(1, 'a, "b"', 2.5)], "i int, s string, d double")
    write_table(with_comma, f"{folder}/b_TRAIN.csv")
    train, test = read_pair(spark, folder)
    assert test is None and train.collect() == [(1, 'a, "b"', 2.5)]
    write_table(with_comma, f"{folder}/test.csv")
    assert read_pair(spark, folder)[1].count() == 1
    with pytest.raises(FileNotFoundError):
        read_pair(spark, folder, kind="json")
    cache = scratch_path(spark, "cache")
    write_feature_cache(train, None, cache)
    assert read_feature_cache(spark, cache)[1] is None
    with pytest.raises(ValueError, match="unknown format"):
        read_table(spark, "x", "xlsx")


def test_command_line_modes(spark):
    base = scratch_path(spark, "cli")
    people(spark).write.option("header", True).csv(f"{base}/train.csv")
    people(spark, 50).write.option("header", True).csv(f"{base}/test.csv")
    common = ["--target", "survived", "--algorithm", "DecisionTreeClassifier", "--output_columns", "id", "--no_tuning", "--output_dir", f"{base}/out"]
    metrics = run(spark, ["--path", base, *common, "--save_model", "--no_feature_engineering"])
    assert metrics["accuracy"] > 0.9
    scored = spark.read.option("header", True).csv(f"{base}/out/predictions")
    assert scored.columns == ["id", "prediction"] and scored.count() == 50
    again = run(spark, ["--only_test", "--test", f"{base}/test.csv", "--model_path", f"{base}/out/DecisionTreeClassifier_model", "--output_dir", f"{base}/out2"])
    assert again == metrics
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("tabweave.automl.fit_plan", None)  # nothing is prepared again
        assert run(spark, ["--from_cache", *common, "--no_feature_engineering"]) == metrics
    model = f"{base}/out/DecisionTreeClassifier_model"
    assert run(spark, ["--only_test", "--from_cache", "--model_path", model, "--output_dir", f"{base}/out"]) == metrics
    assert spark.read.csv(f"{base}/out/report", header=True).columns == ["class", "precision", "recall", "f1", "support"]
    with pytest.raises(SystemExit):
        run(spark, ["--only_test", "--test", "x"])


def test_flagship_joins_its_rows_once_and_stores_no_row_ids(spark, monkeypatch):
    stored = {}

    def watched(df, name):
        stored[name] = df.columns
        return materialize(df, name)

    monkeypatch.setattr(models, "materialize", watched)
    monkeypatch.setattr(automl, "materialize", watched)
    folder = scratch_path(spark, "flagship")
    spark.range(90).selectExpr(
        "id % 30 AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "int(id % 7) AS l_linenumber", "double(id % 13) AS l_quantity",
        "id * 1.5D AS l_extendedprice", "id % 3 / 100.0D AS l_discount", "id % 5 / 100.0D AS l_tax", "if(id % 2 = 0, 'A', 'R') AS l_returnflag",
        "if(id % 4 = 0, 'O', 'F') AS l_linestatus", "timestamp'2024-01-01' AS l_shipdate",
    ).write.parquet(f"{folder}/lineitem.parquet")
    spark.range(30).selectExpr(
        "id AS o_orderkey", "if(id % 3 = 0, 'F', 'O') AS o_orderstatus", "id * 2.5D AS o_totalprice", "concat('p', id % 4) AS o_orderpriority"
    ).write.parquet(f"{folder}/orders.parquet")
    report = models.flagship(spark, folder)
    assert report.where("class = 'accuracy'").first()["support"] == 90
    assert "o_orderpriority" in stored["flagship-rows"] and stored["matrix"] == ["label", "features"]
