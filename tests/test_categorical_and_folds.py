import datetime
import random

import pytest
from pyspark.sql import functions as F

from tabweave.operators import categorical, dates, evaluate, folds, lookup, scaling, selection
from tabweave.operators.lookup import measure
from tabweave.plans.feature_plan import fit_plan
from tabweave.plans.roles import Roles


def hot_frame(spark):
    """One value on a third of the rows, some nulls, many rare values."""
    word = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("w"), F.col("id") % 50))
    return spark.range(900).select("id", word.alias("w"), (F.col("id") % 5).cast("double").alias("y"))


@pytest.mark.parametrize("limit", [lookup.BROADCAST_BYTES, 0])
def test_lookup_paths_agree_on_a_hot_value(spark, limit):
    df = hot_frame(spark)
    found = categorical.fit_lookups(df, ["w"], "y")["w"]
    assert found.hot[0] == "hot" and found.top == "hot"
    out = lookup.attach(df, "w", found, {"n": F.col("__n"), "m": F.col("__mean")}, broadcast_bytes=limit)
    want = df.toPandas()
    counts, means = want.groupby("w").size(), want.groupby("w")["y"].mean()
    rows = {r["id"]: r for r in out.collect()}
    assert len(rows) == 900
    for i, w in zip(want["id"], want["w"]):
        if w is None:
            assert rows[i]["n"] is None and rows[i]["m"] is None
        else:
            assert rows[i]["n"] == counts[w] and rows[i]["m"] == pytest.approx(means[w])


def test_rare_flag_marks_all_but_the_top_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), ("c",)], "w string")
    out = categorical.frequency_features(df, categorical.fit_lookups(df, ["w"]), ["w"]).collect()
    assert {r["w"]: r["w_is_rare"] for r in out} == {"a": 0, "b": 1, None: 1, "c": 1}


def test_encoder_choice_by_distinct_count(spark):
    df = spark.range(400).selectExpr(
        "id", "cast(id % 10 as string) ten", "cast(id % 12 as string) twelve", "cast(id % 40 as string) forty", "double(id % 2) y"
    )
    spec, _ = categorical.fit_encoders(df, Roles("y", ("id",)))
    assert spec["target"] == ["twelve", "forty"] and list(spec["one_hot"]) == ["ten"] and not spec["count"]
    spec, _ = categorical.fit_encoders(df.drop("y"), Roles("y", ("id",)))
    assert list(spec["one_hot"]) == ["ten", "twelve"] and spec["count"] == ["forty"]


def test_labels_round_trip_and_replay(spark):
    df = spark.createDataFrame([("no",), ("yes",), ("maybe",)], "y string")
    classes = categorical.fit_labels(df, "y")
    assert classes == ["maybe", "no", "yes"]
    new = spark.createDataFrame([("yes",), ("other",)], "y string")
    assert [r[0] for r in categorical.encode_labels(new, "y", classes, True).collect()] == [2.0, 0.0]
    coded = categorical.encode_labels(df, "y", classes)
    assert [r[0] for r in coded.select(categorical.decode_labels(F.col("y"), classes)).collect()] == ["no", "yes", "maybe"]


def test_one_hot_of_unseen_and_null_is_zero(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "w string")
    assert [tuple(r) for r in categorical.one_hot(df, {"w": ["b", "a"]}).collect()] == [(1, 0), (0, 0), (0, 0)]


def test_dates_from_strings_and_timestamps(spark):
    df = spark.createDataFrame(
        [("2024-02-05", datetime.datetime(2023, 1, 1), "x"), ("bad", None, "y")], "start_date string, at timestamp, other string"
    )
    spec = dates.fit_dates(df, Roles())
    assert spec["columns"] == ["start_date", "at"]
    first, second = dates.apply_dates(df, spec).collect()
    assert (first["start_date_year"], first["start_date_month"], first["start_date_day"], first["start_date_dayofweek"]) == (2024, 2, 5, 0)
    assert first["at_dayofweek"] == 6 and second["start_date_year"] is None and "start_date" not in first.asDict()


@pytest.mark.parametrize("ranges", [1, 4, 64])
def test_folds_equal_window_definitions_under_one_hot_label(spark, ranges):
    df = spark.range(1000).selectExpr("id * 37 % 1009 as id", "if(id % 3 < 2, 'hot', 'cold') as y")
    rows = df.toPandas().sort_values("id")
    got = {r["id"]: r for r in folds.numbered(df, "id", "y", ranges).collect()}
    want = rows.groupby("y").cumcount() + 1
    assert all(got[i]["__row"] == n for i, n in zip(rows["id"], want))
    plain = {r["id"]: r["fold"] for r in folds.add_folds(df, "id", 7).collect()}
    sizes = [list(plain.values()).count(k) for k in range(7)]
    assert sizes == [143] * 6 + [142] and [plain[i] for i in rows["id"]] == sorted(plain.values())


def test_selection_rules(spark):
    scores = {"a": 3.0, "b": float("nan"), "c": 1.0, "d": 1.0}
    assert selection.top_k(scores, 2) == ["a", "d"]
    df = spark.range(50).selectExpr("double(id) a", "double(id * 2 + 1) b", "double(id % 7) c", "5.0D k")
    assert selection.fit_correlation_prune(df, ["a", "b", "c", "k"]) == ["b"]


def test_scaling_constants_become_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, k double")
    for kind, want in (("standard", [(-1.0, 0.0), (1.0, 0.0)]), ("minmax", [(0.0, 0.0), (1.0, 0.0)])):
        assert [tuple(r) for r in scaling.apply_scale(df, scaling.fit_scale(df, ["a", "k"], kind)).collect()] == want


def test_report_with_a_class_never_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("c", "d")], "y string, p string")
    out = {r["class"]: r for r in evaluate.classification_report(df, "y", "p").collect()}
    assert (out["b"]["precision"], out["b"]["recall"], out["b"]["support"]) == (0.0, 0.0, 1)
    assert out["d"]["support"] == 0 and out["accuracy"]["f1"] == 0.5 and out["a"]["precision"] == 0.5


def test_regression_metrics_of_constant_target(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    assert tuple(evaluate.regression_metrics(df, "y", "p").first()) == (0.0, 1.0)


def test_out_of_fold_means_leave_out_the_own_fold(spark):
    """Also for null values, null targets, rows without a fold, and values that one fold alone has."""
    rng = random.Random(1)
    rows = [(k, rng.choice(["a", "b", "c", None]), rng.choice([1.0, 2.0, 5.0, None]), rng.choice([0, 1, 2])) for k in range(60)]
    rows += [(100, "alone", 9.0, 1), (101, "a", 3.0, None)]
    df = spark.createDataFrame(rows, "k int, c string, y double, f int")
    lookups = measure(categorical.fold_statistics(df, ["c"], "y", F.col("f")), ["c"])
    means = categorical.fold_means(df, "y", F.col("f"))
    made = categorical.target_encode_folds(df, lookups, F.col("f"), means, -1.0)
    assert made.columns == ["k", "y", "f", "c_target_encoded"]
    for r in made.collect():
        value = next(x[1] for x in rows if x[0] == r.k)
        others = [y for _, c, y, f in rows if c == value and c is not None and y is not None and (r.f is None or f != r.f)]
        rest = [y for _, _, y, f in rows if y is not None and f != r.f]
        expected = sum(others) / len(others) if others else -1.0 if r.f is None else sum(rest) / len(rest)
        assert abs(r.c_target_encoded - expected) < 1e-9
    later = categorical.target_encode(df, categorical.without_folds(lookups), -1.0).collect()
    known = [y for _, c, y, _ in rows if c == "a" and y is not None]
    assert all(abs(r.c_target_encoded - sum(known) / len(known)) < 1e-9 for r in later if rows[[x[0] for x in rows].index(r.k)][1] == "a")


def test_fit_with_target_folds(spark):
    rows = [(k, f"v{k % 12}", float(k % 12 + k % 5)) for k in range(240)]
    df = spark.createDataFrame(rows, "k int, c string, y double")
    plan, made = fit_plan(df, Roles("y", ("k",)), "regression", target_folds=4)
    plain, _ = fit_plan(df, Roles("y", ("k",)), "regression")
    assert made.columns == plan.transform(df).columns == plain.transform(df).columns
    # scoring knows a value by one number, in the order of the plain means
    name = "c_target_encoded"
    known = [[r[0] for r in p.transform(df).groupBy((F.col("k") % 12).alias("m")).agg(F.min(name), F.max(name)).orderBy(F.col("min(c_target_encoded)")).collect()] for p in (plan, plain)]
    assert known[0] == known[1] and plan.transform(df).select(name).distinct().count() == 12
    assert made.select(name).distinct().count() > 12
