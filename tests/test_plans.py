"""The plans stay the ones wanted at scale."""

import re

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabweave.operators import categorical, numeric, vectorize
from tabweave.operators.text_features import add_cleaned, add_statistics
from tabweave.plans.feature_plan import fit_plan
from tabweave.plans.roles import Roles
from tabweave.session import scratch_path


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, df):
    path = scratch_path(spark, "plans")
    df.write.parquet(path)
    return spark.read.parquet(path)


def wide(spark):
    return stored(
        spark,
        spark.range(300).selectExpr(
            "id", "double(id % 20) a", "double(id % 13) b", "double(id % 7) unused", "concat('w', id % 14) w", "if(id % 3 = 0, 'x', 'z') y"
        ),
    )


def test_row_features_need_no_shuffle_and_read_only_their_columns(spark):
    made = numeric.add_row_statistics(wide(spark), ["a", "b"])
    df = made.select(*numeric.pairwise(["a", "b"]), "row_mean", "row_std", "row_sum")
    plan = plan_of(df)
    assert "Exchange" not in plan and "ReadSchema: struct<a:double,b:double>" in plan


def test_small_lookups_broadcast_and_large_ones_do_not(spark):
    df = wide(spark).select("id", "w")
    lookups = categorical.fit_lookups(df, ["w"])
    assert "BroadcastHashJoin" in plan_of(categorical.frequency_encode(df, lookups))


def test_scoring_is_one_stage_without_python(spark):
    df = wide(spark)
    plan, _ = fit_plan(df, Roles("y", ("id",)), "classification")
    scored = plan_of(plan.vectorize(plan.transform(df.drop("y"))))
    assert not re.search(r"(?<!Broadcast)Exchange (?!SinglePartition)", scored.replace("BroadcastExchange", "")) and "Python" not in scored


def test_text_features_stay_on_the_jvm_without_a_shuffle(spark):
    df = stored(spark, spark.createDataFrame([(1, "some words here"), (2, "other words here"), (3, "nothing")], "i int, t string"))
    made = add_statistics(add_cleaned(df, ["t"]), ["t"])
    assert "Exchange" not in plan_of(made) and "Python" not in plan_of(made)
    spec = vectorize.fit_vocabulary(df, F.col("t"), 10)
    long = plan_of(vectorize.long_terms(df, "i", F.col("t"), spec))
    assert "Python" not in long and "SortMergeJoin" not in long


def test_top_k_is_cut_before_the_shuffle(spark):
    best = Window.partitionBy("w").orderBy("a", "id")
    df = wide(spark).select("*", F.row_number().over(best).alias("rank")).where("rank <= 3")
    assert plan_of(df).count("WindowGroupLimit") == 2


def test_plans_do_not_depend_on_partitions(spark):
    df = spark.range(300).selectExpr("id", "id % 7 AS a", "(id * 37) % 101 / 3 AS b", "concat('c', id % 5) AS c", "id % 3 AS y")
    found = [fit_plan(df, Roles("y", ("id",)), "classification", partitions=n)[0] for n in (1, 4, 9)]
    assert found[0].steps["features"]
    for plan in found[1:]:
        scales = plan.steps["scale"]["scales"]
        assert {c: pytest.approx(v) for c, v in scales.items()} == found[0].steps["scale"]["scales"]
        assert plan.steps | {"scale": None} == found[0].steps | {"scale": None}
