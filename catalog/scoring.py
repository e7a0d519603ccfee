"""Queries over scoring tables that differ from the training table, and over labels that are missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.common import rounded, sql_round, table
from tabweave.automl import AutoTable
from tabweave.plans.feature_plan import FeaturePlan, fit_plan
from tabweave.plans.roles import Roles
from tabweave.session import scratch_path

QUERIES = {}
ORACLES: dict[str, str] = {}


def register(sql: str):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return keep


KEYS = ("l_orderkey", "l_linenumber")
MADE = ("l_quantity", "l_tax", "l_linestatus_F", "l_linestatus_O")


def _training(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*KEYS, "l_quantity", "l_tax", "l_linestatus")


def _scored(spark, sf_dir, test: DataFrame) -> DataFrame:
    """A plan saved and loaded, then applied to another frame."""
    plan, _ = fit_plan(_training(spark, sf_dir), Roles(None, KEYS), "regression", feature_engineering=False)
    path = scratch_path(spark, "plan")
    plan.save(spark, path)
    made = FeaturePlan.load(spark, path).transform(test)
    assert set(made.columns) == {*KEYS, *MADE}, made.columns
    return made.select(*KEYS, *[rounded(F.col(c).cast("double"), 6).alias(c) for c in MADE])


def _expected(quantity: str, tax: str, f: str, o: str) -> str:
    def scaled(value: str, name: str) -> str:
        return sql_round(f"({value} - (SELECT min({name}) FROM lineitem)) / (SELECT max({name}) - min({name}) FROM lineitem)", 6)

    return (
        f"SELECT l_orderkey, l_linenumber, {scaled(quantity, 'l_quantity')} AS l_quantity, {scaled(tax, 'l_tax')} AS l_tax, "
        f"({f})::DOUBLE AS l_linestatus_F, ({o})::DOUBLE AS l_linestatus_O FROM lineitem"
    )


STATUS = ("CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END", "CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END")


@register(_expected("l_quantity", "(SELECT median(l_tax) FROM lineitem)", "0", "0"))
def plan_conforms_missing(spark, sf_dir):
    """Without one numeric and one string column: the training median, and no category."""
    return _scored(spark, sf_dir, _training(spark, sf_dir).drop("l_tax", "l_linestatus"))


@register(_expected("l_quantity", "l_tax", "0", "0"))
def plan_conforms_types(spark, sf_dir):
    """A category read as int, a number read as string."""
    test = _training(spark, sf_dir).withColumns({"l_linestatus": F.col("l_linenumber"), "l_quantity": F.col("l_quantity").cast("string")})
    return _scored(spark, sf_dir, test)


@register(_expected("l_quantity", "l_tax", *STATUS))
def plan_drops_extra(spark, sf_dir):
    """Columns that training never saw, of types no feature has."""
    extra = {"more": F.array("l_tax"), "another": F.create_map(F.lit("a"), "l_tax"), "third": F.lit("x")}
    return _scored(spark, sf_dir, _training(spark, sf_dir).withColumns(extra))


CLASS = "CASE WHEN l_linenumber <= 3 THEN 'low' ELSE 'high' END"
GIVEN = f"CASE WHEN l_orderkey % 5 = 0 THEN NULL WHEN l_orderkey % 7 = 0 THEN 'low' ELSE {CLASS} END"


def _classified(spark, sf_dir, keep: tuple[str, ...]):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("line"), "l_quantity", F.expr(CLASS).alias("size"))
    run = AutoTable("size", "DecisionTreeClassifier", keep=keep, tune=False, feature_engineering=False)
    return run.fit(rows), rows


@register(f"SELECT l_orderkey, l_linenumber AS line, {CLASS} AS size, {CLASS} AS prediction FROM lineitem")
def keep_target(spark, sf_dir):
    """A target that is also kept, not last, comes back as it was given."""
    fitted, rows = _classified(spark, sf_dir, ("size", "l_orderkey", "line"))
    return fitted.transform(rows).select("l_orderkey", "line", "size", "prediction")


@register(f"SELECT {sql_round(f'avg((({GIVEN}) = ({CLASS}))::INT)', 6)} AS accuracy FROM lineitem WHERE ({GIVEN}) IS NOT NULL")
def accuracy_with_null_labels(spark, sf_dir):
    """Rows without a label don't count."""
    fitted, rows = _classified(spark, sf_dir, ("l_orderkey", "line"))
    found = fitted.evaluate(rows.withColumn("size", F.expr(GIVEN)))
    assert fitted.evaluate(rows.withColumn("size", F.lit(None).cast("string"))) == fitted.evaluate(rows.drop("size")) == {}
    return spark.createDataFrame([(found["accuracy"],)], "accuracy double").select(rounded("accuracy", 6).alias("accuracy"))


@register(
    f"WITH p AS (SELECT ({GIVEN}) AS y, ({CLASS}) AS g FROM lineitem WHERE ({GIVEN}) IS NOT NULL), c AS (SELECT unnest(['high', 'low']) AS class) "
    f"SELECT class, {sql_round('sum((y = class AND g = class)::INT) / sum((g = class)::INT)', 6)} AS precision, "
    f"{sql_round('sum((y = class AND g = class)::INT) / sum((y = class)::INT)', 6)} AS recall, sum((y = class)::INT)::BIGINT AS support FROM c, p GROUP BY class"
)
def report_with_null_labels(spark, sf_dir):
    fitted, rows = _classified(spark, sf_dir, ("l_orderkey", "line"))
    report = fitted.report(rows.withColumn("size", F.expr(GIVEN))).filter(F.col("class").isin("high", "low"))
    return report.select("class", rounded("precision", 6).alias("precision"), rounded("recall", 6).alias("recall"), "support")
