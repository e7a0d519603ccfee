import numpy as np
import pandas as pd
import pytest

from tabweave.functions.quantiles import quantiles
from tabweave.operators import missing, numeric, prune
from tabweave.operators.profile import distinct_counts, profile
from tabweave.plans.roles import Roles, normalize

SHARES = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def frame(spark, values, name="x"):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], f"{name} double")


@pytest.mark.parametrize("shape", ["uniform", "hot", "heavy_tail", "two_values", "negative"])
@pytest.mark.parametrize("buffer_values", [1, 7, 50_000])
def test_exact_quantiles_equal_numpy(spark, shape, buffer_values):
    draw = np.random.RandomState(3)
    values = {
        "uniform": draw.uniform(size=501),
        "hot": np.where(draw.uniform(size=600) < 0.4, 5.0, draw.normal(5, 1, size=600)),
        "heavy_tail": np.exp(draw.normal(0, 8, size=400)),
        "two_values": np.array([1.0] * 200 + [9.0] * 200),
        "negative": draw.normal(-1e9, 5, size=333),
    }[shape]
    found = quantiles(frame(spark, values), {"x": SHARES}, buffer_values=buffer_values)["x"]
    np.testing.assert_allclose(found, np.quantile(values, SHARES), rtol=1e-12)


def test_quantiles_skip_nulls_and_survive_no_values(spark):
    assert quantiles(frame(spark, [None, 1, 3]), {"x": [0.5]})["x"] == [2.0]
    assert quantiles(frame(spark, [None, None]), {"x": [0.5]})["x"] == [None]


def test_profile_counts_skew_and_minimum(spark):
    values = [1, 1, 2, 9, None]
    found = profile(frame(spark, values))["x"]
    assert (found.rows, found.nulls, found.distinct, found.minimum) == (5, 1, 3, 1.0)
    assert found.skew == pytest.approx(pd.Series(values).skew())


def test_sketched_and_exact_profile_agree_near_limits(spark):
    df = spark.range(2000).selectExpr("id % 10 a", "id % 11 b", "id % 16 c", "cast(id % 1800 as string) d", "5 e", "id f")
    exact, quick = profile(df, exact=True), profile(df)
    assert prune.fit_prune(exact).keys() == prune.fit_prune(quick).keys() == {"e", "f"}
    assert {c: quick[c].distinct for c in "abcde"} == {c: exact[c].distinct for c in "abcde"}


def test_distinct_counts_keep_value_types_apart(spark):
    df = spark.sql("select * from values (1L, 1.0D, '1', date'2020-01-01'), (2L, 1.5D, '01', null) t(a, b, c, d)")
    assert distinct_counts(df, ["a", "b", "c", "d"]) == {"a": 2, "b": 2, "c": 2, "d": 1}


def test_prune_reasons_in_order(spark):
    rows = [(i, 7, None if i % 10 else i, "x" if i % 2 else "y") for i in range(100)]
    df = spark.createDataFrame(rows, "id int, same int, holes int, ok string")
    assert prune.fit_prune(profile(df, exact=True)) == {"id": "all_unique", "same": "constant", "holes": "mostly_null"}


def test_alignment_and_conform(spark):
    train = spark.createDataFrame([(1, 2.0, 3.0, "t")], "id int, a double, b double, y string")
    test = spark.createDataFrame([(1, 9.0, 5.0)], "id int, b double, extra double")
    left, right, features = prune.align(train, test, Roles("y", ("id",)))
    assert features == ["b", "a"] and left.columns == ["b", "a", "id", "y"]
    assert right.collect()[0].asDict() == {"b": 9.0, "a": 0.0, "id": 1}
    with pytest.raises(ValueError, match="available columns"):
        prune.split_target(train, "nope")


def test_leak_rule_is_substring():
    assert prune.leaking_columns(["age", "age_bin", "page", "y"], "age") == ["age_bin", "page"]


def test_missing_tiers_by_null_share(spark):
    rows = [(i, None if i < 9 else 1.0, None if i < 5 else 2.0, float(i) if i else None, None if i < 2 else "s") for i in range(10)]
    df = spark.createDataFrame(rows, "id int, most double, half double, few double, word string")
    spec = missing.fit_missing(df, Roles(None, ("id",)))
    assert spec["drop"] == ["most"] and spec["flag"] == ["half"]
    out = {r["id"]: r for r in missing.apply_missing(df, spec).collect()}
    assert out[0]["half"] == -999 and out[0]["half_is_missing"] == 1 and out[9]["half_is_missing"] == 0
    assert out[0]["few"] == 5.0 and out[0]["word"] == "Unknown"


def test_mode_takes_smallest_of_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "w string")
    assert missing.mode_values(df, ["w"]) == {"w": "a"}
    assert missing.mode_values(df.where("w is null"), ["w"]) == {"w": "Unknown"}


def test_bins_equal_pandas(spark):
    draw = np.random.RandomState(1)
    for values in (draw.exponential(size=200), np.repeat([1.0, 2, 3, 4, 5, 6, 7], [90, 3, 4, 5, 6, 7, 8])):
        df = frame(spark, [*values, None])
        edges = numeric.quantile_edges(df, ["x"])["x"]
        got = [r[0] for r in df.select(numeric.bin_index(df["x"], edges)).collect()]
        want = pd.qcut(pd.Series([*values, None]), 5, duplicates="drop", labels=False)
        assert got[:-1] == want[:-1].astype(int).tolist() and got[-1] is None
        wide = numeric.equal_width_edges(df, ["x"])["x"]
        got = [r[0] for r in df.select(numeric.bin_index(df["x"], wide)).collect()]
        assert got[:-1] == pd.cut(pd.Series(values), 5, labels=False).tolist()


def test_row_statistics_skip_nulls(spark):
    df = spark.createDataFrame([(1.0, 2.0, 6.0), (None, 4.0, None), (None, None, None)], "a double, b double, c double")
    got = [tuple(r) for r in numeric.add_row_statistics(df, ["a", "b", "c"]).drop("a", "b", "c").collect()]
    assert got[0] == (3.0, pytest.approx(7**0.5), 9.0)
    assert got[1] == (4.0, None, 4.0) and got[2] == (None, None, 0.0)


def test_zero_divisor_is_null(spark):
    assert len(numeric.pairwise([f"c{i}" for i in range(21)])) == 420
    df = spark.createDataFrame([(1.0, -1e-8)], "a double, b double")
    assert df.select(numeric.ratio("a", "b")).first()[0] is None


def test_log_needs_positive_minimum_and_skew(spark):
    rows = [(float(i), float(i) ** 4 + 1, float(i) ** 4) for i in range(40)]
    spec = numeric.fit_numeric(spark.createDataFrame(rows, "flat double, bent double, zero double"), Roles())
    assert spec["logs"] == ["bent"] and spec["row_statistics"] == ["flat", "bent", "zero"]


def test_normalize_rejects_nested_types_unless_kept(spark):
    df = spark.sql("select array(1) a, cast('1.5' as decimal(5,2)) d, double('nan') n")
    with pytest.raises(TypeError, match="array"):
        normalize(df, Roles())
    assert normalize(df, Roles(None, ("a",))).first().asDict() == {"a": [1], "d": 1.5, "n": None}


def test_counted_quantiles_send_each_value_once_to_the_task_of_its_column(spark):
    """Of many tasks with the same values no task gets them all from each; nulls don't count, and each column has its own shares."""
    df = spark.range(0, 4_000, 1, 40).selectExpr("CAST(id % 100 AS double) AS a", "CASE WHEN id % 3 = 0 THEN id % 7 END AS b", "CAST(NULL AS double) AS c")
    wanted = {"a": [0.0, 0.37, 1.0], "b": [0.5], "c": [0.5]}
    found = quantiles(df, wanted)
    rows = df.collect()
    for c in ("a", "b"):
        assert found[c] == pytest.approx(np.quantile([r[c] for r in rows if r[c] is not None], wanted[c]).tolist())
    assert found["c"] == [None]
    kind, seen = type(df), []
    run = kind.agg

    def watched(self, *aggs):
        seen.extend(str(a) for a in aggs)
        return run(self, *aggs)

    kind.agg = watched
    try:
        quantiles(df, wanted)
    finally:
        kind.agg = run
    assert seen and not any("percentile" in a for a in seen)
