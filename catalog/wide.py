"""Queries over tables of many columns, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import table
from tabweave.operators import pairs, prune, selection
from tabweave.plans.feature_plan import fit_plan
from tabweave.plans.roles import Roles

QUERIES = {}
ORACLES: dict[str, str] = {}


def register(sql: str):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return keep


DIMENSIONS = 64
EACH = "SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings"


# Every third dimension is rounded to a few values, so pair features fall on both sides of the rules; every fifth row of a seventh has a null.
@register(
    f"WITH e AS (SELECT vec_id, i, CASE WHEN i % 7 = 0 AND vec_id % 5 = 0 THEN NULL WHEN i % 3 = 0 THEN round(x * 4) ELSE x END AS x FROM ({EACH})), "
    "p AS (SELECT a.i AS i, b.i AS j, a.x * b.x AS product, a.x / nullif(b.x + 1e-8, 0) AS ratio FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i < b.i), "
    "f AS (SELECT 'e' || i || '_x_e' || j AS feature, product AS v FROM p UNION ALL SELECT 'e' || i || '_div_e' || j, ratio FROM p), "
    "c AS (SELECT feature, count(*) AS n_rows, count(*) - count(v) AS n_null, count(DISTINCT v + 0.0) AS n FROM f GROUP BY 1) "
    "SELECT feature, n_null, (n > 1 AND n_null <= 0.5 * n_rows AND n <= 0.9 * n_rows) AS kept FROM c"
)
def wide_pair_features(spark, sf_dir):
    """What the pruning rules leave of 4,032 products and ratios that are never columns."""
    x = [F.col("embedding")[i].cast("double") for i in range(DIMENSIONS)]
    few = [F.rint(v * 4) if i % 3 == 0 else v for i, v in enumerate(x)]
    holed = [F.when(F.col("vec_id") % 5 != 0, v) if i % 7 == 0 else v for i, v in enumerate(few)]
    df = table(spark, sf_dir, "embeddings").select(*[v.alias(f"e{i}") for i, v in enumerate(holed)])
    found = pairs.profile_pairs(df, df.columns)
    rows = [(pairs.name_of(k), p.nulls, prune.prune_reason(p) is None) for k, p in found.items()]
    return spark.createDataFrame(rows, "feature string, n_null long, kept boolean")


WIDE_COLUMNS = 200


@register(
    f"WITH e AS ({EACH}), "
    "w AS (SELECT vec_id, i AS j, x FROM e "
    "UNION ALL SELECT a.vec_id, a.i + 64, 2 * a.x + (a.i % 16) / 10.0 * b.x FROM e a JOIN e b ON a.vec_id = b.vec_id AND b.i = (7 * a.i + 1) % 64 "
    "UNION ALL SELECT vec_id, i + 128, 1000 - x * x FROM e "
    "UNION ALL SELECT vec_id, i + 192, 0.1 FROM e WHERE i < 4 "
    "UNION ALL SELECT vec_id, i + 196, 1000 + 3 * x FROM e WHERE i < 4), "
    "r AS (SELECT b.j AS j, corr(a.x, b.x) AS r FROM w a JOIN w b ON a.vec_id = b.vec_id AND a.j < b.j WHERE a.j NOT BETWEEN 192 AND 195 AND b.j NOT BETWEEN 192 AND 195 GROUP BY a.j, b.j) "
    "SELECT 'c' || j AS column_name, coalesce(max(abs(r)) > 0.95, false) AS dropped FROM (SELECT DISTINCT j FROM w) LEFT JOIN r USING (j) GROUP BY 1"
)
def wide_correlation_prune(spark, sf_dir):
    """200 columns in blocks of 32: copies with more or less noise, squares, constants, and copies of another scale."""
    x = [F.col("embedding")[i].cast("double") for i in range(DIMENSIONS)]
    made = [
        *x,
        *[2 * v + (i % 16) / 10 * x[(7 * i + 1) % 64] for i, v in enumerate(x)],
        *[1000 - v * v for v in x],
        *[F.lit(0.1)] * 4,
        *[1000 + 3 * v for v in x[:4]],
    ]
    df = table(spark, sf_dir, "embeddings").select(*[v.alias(f"c{j}") for j, v in enumerate(made)])
    gone = selection.fit_correlation_prune(df, df.columns, block=32)
    return spark.createDataFrame([(c, c in gone) for c in df.columns], "column_name string, dropped boolean")


@register(
    f"WITH e AS ({EACH}), q AS (SELECT i, quantile_cont(x, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS c FROM e GROUP BY i), "
    "b AS (SELECT label, i, CASE WHEN x <= c[2] THEN 0 WHEN x <= c[3] THEN 1 WHEN x <= c[4] THEN 2 WHEN x <= c[5] THEN 3 ELSE 4 END AS v FROM e JOIN q USING (i)), "
    "g AS (SELECT i, label, count(*) AS n, avg(v) AS m, sum(v * v) - sum(v) * sum(v) / count(*) AS w FROM b GROUP BY 1, 2), "
    "a AS (SELECT i, avg(v) AS mean FROM b GROUP BY 1), "
    "f AS (SELECT i, (sum(n * (m - mean) * (m - mean)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))) AS f FROM g JOIN a USING (i) GROUP BY 1) "
    "SELECT 'e' || i || '_bin' AS feature FROM (SELECT i, row_number() OVER (ORDER BY f DESC, i DESC) AS r FROM f) WHERE r <= 51"
)
def wide_fit(spark, sf_dir):
    """A fit of 64 embedding columns with default settings: of some 4,400 features the rules leave 64 bins, of which the best 51 stay."""
    x = [F.col("embedding")[i].alias(f"e{i}") for i in range(DIMENSIONS)]
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", *x)
    plan, _ = fit_plan(rows, Roles("label", ("vec_id",)), "classification")
    return spark.createDataFrame([(c,) for c in plan.steps["selected"]], "feature string")
