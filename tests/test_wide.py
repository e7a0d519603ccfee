"""Many columns: products in blocks, leading components, pair features that never become columns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.operators import gram, numeric, pairs, pca, selection
from tabweave.operators.profile import profile
from tabweave.operators.prune import prune_reason
from tabweave.plans.feature_plan import fit_plan
from tabweave.plans.roles import Roles


def frame(spark, x, names=None):
    names = names or [f"x{k}" for k in range(x.shape[1])]
    return spark.createDataFrame([tuple(None if math.isnan(v) else float(v) for v in row) for row in x], ", ".join(f"{n} double" for n in names)).repartition(3)


def wide(seed=1, n=80, d=50):
    """Columns with means far from 0, near copies, a constant one and one with a null."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) + 1000.0
    for j in (7, 20, 33):
        x[:, j] = 3 * x[:, j - 5] + 0.01 * rng.standard_normal(n)
    x[:, 40] = 0.1
    x[3, 45], x[:, 46] = np.nan, x[:, 45]
    return x


@pytest.mark.parametrize("block, tile", [(8, 16), (7, 100), (256, 2048)])
def test_correlation_in_blocks(spark, block, tile):
    x = wide()
    df = frame(spark, x)
    made = gram.Gram(df, df.columns, block, tile)
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.abs(np.corrcoef(x.T))
    r[40] = r[:, 40] = np.nan
    expected = [f"x{j}" for j in range(x.shape[1]) if (r[:j, j] > 0.95).any()]
    assert made.strong_columns(0.95) == expected == ["x7", "x20", "x33"]
    assert selection.fit_correlation_prune(df, df.columns, block=block) == expected
    centred = np.nan_to_num(x - np.nanmean(x, axis=0))
    whole = [k for k in range(x.shape[1]) if k not in (45, 46)]
    assert np.allclose(made.squares()[whole], (centred**2).sum(axis=0)[whole], rtol=1e-9, atol=1e-12)
    assert selection.fit_correlation_prune(df.limit(0), df.columns) == []


def test_products_of_a_matrix_in_blocks(spark):
    x = np.random.default_rng(3).standard_normal((60, 21))
    df = frame(spark, x)
    c = x - x.mean(axis=0)
    q = np.random.default_rng(4).standard_normal((21, 5))
    assert np.allclose(gram.Gram(df, df.columns, 4, 8).times(q), c.T @ c @ q)


def test_leading_components_beyond_the_direct_width(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((200, 60)) * 0.8 ** np.arange(60) @ np.linalg.qr(rng.standard_normal((60, 60)))[0]
    df = frame(spark, x)
    spec, model = pca.fit_pca(df, df.columns, direct=10, start=8)
    plain, exact = pca.fit_pca(df, df.columns)
    assert len(spec["shares"]) == len(plain["shares"]) < 60
    assert np.allclose(spec["shares"], plain["shares"], rtol=1e-6)
    model.write().overwrite().save(str(tmp_path / "pc"))
    again = pca.PCAModel.load(str(tmp_path / "pc"))
    a, b = (np.array([list(r) for r in pca.apply_pca(df, s, m).collect()]) for s, m in ((spec, again), (plain, exact)))
    # row order is that of the frame; signs are fixed
    assert np.allclose(a, b, atol=1e-3)


def test_regression_scores_in_one_scan(spark):
    x = wide(6)
    x[:, 30] = 2 * x[:, 31]
    x[::7, 12] = np.nan
    names = [f"x{k}" for k in range(31)]
    df = frame(spark, x).withColumn("y", F.when(F.col("x31") > 998.5, F.col("x31"))).withColumn("nothing", F.lit(None).cast("double"))
    got = selection.regression_scores(df, [*names, "x40", "nothing"], "y")
    kept = x[x[:, 31] > 998.5]
    for k, name in enumerate(names):
        known = ~np.isnan(kept[:, k])
        r2 = np.corrcoef(kept[known, k], kept[known, 31])[0, 1] ** 2
        if k == 30:
            assert got[name] > 1e12
        else:
            assert got[name] == pytest.approx(r2 / (1 - r2) * (len(kept) - 2), rel=1e-6)
    assert math.isnan(got["nothing"]) and (math.isnan(got["x40"]) or got["x40"] < 1)


def pair_frame(spark, n=400):
    rng = np.random.default_rng(8)
    few, some = rng.integers(0, 5, n).astype(float), rng.integers(-30, 30, n).astype(float)
    rows = []
    for k in range(n):
        a = None if k % 3 == 0 else float(few[k])
        b = -1e-8 if k % 5 == 0 else float(some[k])
        rows.append((a, b, float(rng.standard_normal()), float(k % 7), None if k % 4 else math.inf, int(k // 2)))
    return spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f long").repartition(4)


@pytest.mark.parametrize("together", [32_768, 10])
def test_pair_profiles_equal_columns(spark, monkeypatch, together):
    monkeypatch.setattr(pairs, "FEATURES_PER_PASS", together)
    df = pair_frame(spark)
    names = df.columns
    made = df.select(*numeric.pairwise(names))
    plain = profile(made, exact=True, moments=False)
    got = {pairs.name_of(k): p for k, p in pairs.profile_pairs(df, names).items()}
    assert list(got) == made.columns
    for c in made.columns:
        assert (got[c].rows, got[c].nulls) == (plain[c].rows, plain[c].nulls)
        assert abs(got[c].distinct - plain[c].distinct) <= 0.05 * plain[c].distinct
        assert prune_reason(got[c]) == prune_reason(plain[c]) or {prune_reason(got[c]), prune_reason(plain[c])} == {"all_unique", "near_unique"}
    assert all(p.rows == 0 for p in pairs.profile_pairs(df.limit(0), names).values())


def test_sketch_error(spark):
    rng = np.random.default_rng(9)
    for n in (0, 1, 2, 100, 3000, 9000, 12_000, 30_000, 300_000):
        registers = np.zeros((2, 1 << pairs.SKETCH_BITS), np.uint8)
        values = np.repeat(rng.standard_normal((n, 1)), 2, axis=1)
        for part in (values, values[::-1]):
            pairs._observe(registers, part, np.ones(part.shape, bool))
        assert np.all(np.abs(pairs.estimate(registers) - n) <= max(0.01, 0.055 * n))


def test_default_fit_of_many_columns(spark):
    """No limit on columns: 24 numeric ones have 552 pair features, of which only those stay that the rules leave."""
    rng = np.random.default_rng(10)
    x = rng.standard_normal((300, 24))
    x[:, :4] = rng.integers(0, 4, (300, 4))
    df = frame(spark, x).withColumn("y", (F.col("x0") > 1).cast("int"))
    plan, data = fit_plan(df, Roles("y"), "classification")
    assert [k[0] for k in plan.steps["numeric"]["pairs"] if k[1:] == ["x1", "x2"]] == ["x", "div"]
    assert ["x", "x20", "x21"] not in plan.steps["numeric"]["pairs"]
    assert plan.steps["reasons"]["x20_div_x21"] in ("all_unique", "near_unique")
    assert sorted(plan.transform(df).columns) == sorted(data.columns)
