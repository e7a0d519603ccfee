"""From a training table to a tuned model, and from there to predictions."""

from __future__ import annotations

import datetime
import json
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorSizeHint
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.models.registry import grid, measure_shape, task_of
from tabweave.models.tuning import candidates, cross_score, distinct_candidates, fit_default, search
from tabweave.operators import evaluate
from tabweave.operators.categorical import decode_labels
from tabweave.operators.folds import add_folds
from tabweave.operators.prune import drop_columns
from tabweave.operators.text_features import detect_text_columns
from tabweave.plans.feature_plan import FeaturePlan, fit_plan
from tabweave.plans.roles import KEPT_TARGET, Roles, col
from tabweave.plans.text_plan import TextPlan, fit_text_plan
from tabweave.session import materialize
from tabweave.sources.tables import prediction_name, predictions_table, write_table


#: Marks rows that hold the model's features already.
PREPARED = "__prepared"


@dataclass
class AutoTable:
    """Settings of a run; ``fit`` returns a :class:`FittedTable`."""

    target: str
    algorithm: str
    task: str | None = None
    keep: tuple[str, ...] = ()
    text: tuple[str, ...] | None = None
    dataset_type: str = "structured"
    cv_folds: int = 3
    seed: int = 42
    tune: bool = True
    feature_engineering: bool = True
    handle_missing: bool = True
    encode_categorical: bool = True
    nlp_method: str = "tfidf"
    max_features: int = 2000
    topic_modeling: bool = True
    dimensionality_reduction: bool = True
    exact: bool = True
    parallelism: int = 4
    partitions: int | None = None
    target_folds: int = 0
    params: dict | None = None

    def __post_init__(self):
        self.task = self.task or task_of(self.algorithm)
        grid(self.algorithm, self.task)
        if self.dataset_type not in ("structured", "text", "mixed"):
            raise ValueError(f"unknown dataset type '{self.dataset_type}'")

    def prepare(self, train: DataFrame) -> tuple[FeaturePlan, TextPlan | None, DataFrame]:
        """Fit the plans; the frame returned has the target and a ``features`` vector."""
        text_plan, late = None, ()
        text = tuple(self.text or ())
        if self.dataset_type != "structured":
            text = text or tuple(detect_text_columns(train, Roles(self.target, tuple(self.keep))))
            text_plan, train = fit_text_plan(
                train,
                list(text),
                self.nlp_method,
                self.max_features,
                self.topic_modeling,
                self.dimensionality_reduction,
                seed=self.seed,
            )
            late = tuple(text_plan.numeric)
            if self.dataset_type == "text":
                only = {self.target, *self.keep, *text, *late, *text_plan.vectors}
                train = drop_columns(train, [c for c in train.columns if c not in only])
        vectors = tuple(text_plan.vectors) if text_plan else ()
        roles = Roles(self.target, (*self.keep, *vectors), text)
        plan, data = fit_plan(
            train,
            roles,
            self.task,
            self.feature_engineering,
            self.handle_missing,
            self.encode_categorical,
            self.exact,
            late,
            self.partitions,
            self.target_folds,
        )
        return plan, text_plan, plan.vectorize(_dense(data, text_plan), vectors)

    def fit(self, train: DataFrame) -> FittedTable:
        return self.fit_prepared(*self.prepare(train))

    def fit_prepared(self, plan: FeaturePlan, text_plan: TextPlan | None, data: DataFrame) -> FittedTable:
        """Fit on a matrix that :meth:`prepare` made, now or in an earlier run."""
        if not self.handle_missing:
            _check_whole(plan.features, data)
        rows = data.select(col(self.target).cast("double").alias("label"), "features")
        if self.tune:
            # rows go by their content, so folds don't depend on how they lie; equal rows may change places, and are spread
            order = F.struct(F.xxhash64("label", "features").alias("hash"), F.monotonically_increasing_id().alias("place"))
            rows = rows.select("*", order.alias("row_id"))
        rows = materialize(rows, "matrix")
        shape = measure_shape(rows, self.task)
        fitted = FittedTable(self, plan, text_plan)
        if not self.tune:
            found = fit_default(rows, self.algorithm, shape, self.seed, self.params)
        else:
            by = "label" if self.task == "classification" else None
            folded = materialize(add_folds(rows, "row_id", self.cv_folds, by), "folds")
            common = (shape, self.cv_folds, "fold", self.seed, self.parallelism)
            score, spread = cross_score(folded, self.algorithm, self.task, {}, *common[:-1])
            fitted.baseline = {"score": score, "spread": spread}
            kind, points = candidates(self.algorithm, self.task, self.cv_folds, self.seed)
            found = search(folded, self.algorithm, self.task, distinct_candidates(self.algorithm, points), *common)
            fitted.search = kind
        fitted.model, fitted.params, fitted.score = found.model, found.params, found.score
        return fitted


def save_prepared(spark: SparkSession, path: str, plan: FeaturePlan, text_plan: TextPlan | None, data: DataFrame) -> None:
    """The fitted plans and the training matrix."""
    write_table(data, f"{path}/train", "parquet")
    plan.save(spark, f"{path}/features")
    if text_plan is not None:
        text_plan.save(spark, f"{path}/text")


def load_prepared(spark: SparkSession, path: str, settings: AutoTable) -> tuple[FeaturePlan, TextPlan | None, DataFrame]:
    text_plan = None if settings.dataset_type == "structured" else TextPlan.load(spark, f"{path}/text")
    return FeaturePlan.load(spark, f"{path}/features"), text_plan, spark.read.parquet(f"{path}/train")


def _check_whole(columns: list[str], data: DataFrame) -> None:
    """Names the columns that an estimator would fail on, before it runs."""
    found = data.agg(*[F.count_if(col(c).isNull()).alias(f"n{k}") for k, c in enumerate(columns)]).first()
    holes = [c for k, c in enumerate(columns) if found[k]]
    if holes:
        raise ValueError(f"columns with nulls and handle_missing=False: {holes}")


def _dense(df: DataFrame, text_plan: TextPlan | None) -> DataFrame:
    """SVD arrays as vectors of known size, which the assembler needs on streams."""
    arrays = {f"{c}_svd": basis.shape[1] for c, basis in text_plan.bases.items()} if text_plan else {}
    df = df.select(*[array_to_vector(col(c)).alias(c) if c in arrays else col(c) for c in df.columns])
    for name, size in arrays.items():
        df = VectorSizeHint(inputCol=name, size=size, handleInvalid="optimistic").transform(df)
    return df


@dataclass
class FittedTable:
    """A fitted run. ``transform`` needs no target and takes batch or streaming frames."""

    settings: AutoTable
    plan: FeaturePlan
    text_plan: TextPlan | None = None
    model: PipelineModel | None = None
    params: dict = field(default_factory=dict)
    score: float | None = None
    baseline: dict | None = None
    search: str | None = None
    metrics: dict = field(default_factory=dict)

    def features(self, df: DataFrame) -> DataFrame:
        """The rows as the model sees them; those that :meth:`prepared` returned stay as they are."""
        if PREPARED in df.columns:
            return df.drop(PREPARED)
        if self.text_plan:
            df = self.text_plan.transform(df)
        vectors = tuple(self.text_plan.vectors) if self.text_plan else ()
        return self.plan.vectorize(_dense(self.plan.transform(df), self.text_plan), vectors)

    def prepared(self, df: DataFrame) -> DataFrame:
        """Features that can be stored, and scored later without the raw table."""
        return self.features(df).withColumn(PREPARED, F.lit(True))

    def _scored(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.features(df))

    def transform(self, df: DataFrame) -> DataFrame:
        """Kept columns and the prediction; classes come back as they were given."""
        name = prediction_name(self.settings.keep, self.settings.task, self.settings.target)
        scored = self._scored(df)
        if self.plan.classes is not None:
            scored = scored.withColumn("prediction", decode_labels(F.col("prediction"), self.plan.classes))
        if KEPT_TARGET in scored.columns:
            scored = scored.withColumn(self.settings.target, F.col(KEPT_TARGET))
        return predictions_table(scored, self.settings.keep, name)

    def evaluate(self, df: DataFrame) -> dict:
        """Metrics on labelled rows; empty when the target is absent or null everywhere."""
        target = self.settings.target
        if target not in df.columns or df.where(col(target).isNotNull()).isEmpty():
            return {}
        scored = self._scored(df.where(col(target).isNotNull()))
        if self.settings.task == "classification":
            found = evaluate.accuracy(scored, self.settings.target, "prediction")
        else:
            found = evaluate.regression_metrics(scored, self.settings.target, "prediction")
        self.metrics = found.first().asDict()
        return self.metrics

    def report(self, df: DataFrame) -> DataFrame:
        """Classification report with the original class names, over the labelled rows."""
        scored = self._scored(df.where(col(self.settings.target).isNotNull()))
        classes = self.plan.classes
        pair = scored.select(
            decode_labels(col(self.settings.target), classes).alias("label"),
            decode_labels(F.col("prediction"), classes).alias("guess"),
        )
        return evaluate.classification_report(pair, "label", "guess")

    def run_info(self, spark: SparkSession) -> DataFrame:
        """One row that records the run."""
        s = self.settings
        name = prediction_name(s.keep, s.task, s.target)
        row = (
            s.algorithm,
            s.task,
            s.target,
            json.dumps(self.params),
            json.dumps(self.metrics),
            list(s.keep),
            name,
            list(self.plan.features),
            s.cv_folds,
            s.seed,
            datetime.datetime.now().isoformat(),
        )
        schema = (
            "algorithm string, task_type string, target_column string, best_parameters string, metrics string, "
            "output_columns array<string>, prediction_column string, feature_names array<string>, cv_folds int, "
            "random_state int, timestamp string"
        )
        return spark.createDataFrame([row], schema)

    def save_results(self, df: DataFrame, path: str, kind: str = "csv") -> None:
        """Predictions and the run record."""
        write_table(self.transform(df), f"{path}/predictions", kind)
        self.run_info(df.sparkSession).coalesce(1).write.mode("overwrite").json(f"{path}/training_info")

    def save(self, spark: SparkSession, path: str) -> None:
        self.plan.save(spark, f"{path}/features")
        if self.text_plan:
            self.text_plan.save(spark, f"{path}/text")
        self.model.write().overwrite().save(f"{path}/model")
        side = {
            "settings": self.settings.__dict__,
            "params": self.params,
            "score": self.score,
            "baseline": self.baseline,
            "search": self.search,
            "metrics": self.metrics,
            "has_text": self.text_plan is not None,
        }
        spark.createDataFrame([(json.dumps(side),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/run")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedTable:
        side = json.loads(spark.read.text(f"{path}/run").first()[0])
        settings = side["settings"] | {"keep": tuple(side["settings"]["keep"])}
        out = cls(AutoTable(**settings), FeaturePlan.load(spark, f"{path}/features"))
        if side["has_text"]:
            out.text_plan = TextPlan.load(spark, f"{path}/text")
        out.model = PipelineModel.load(f"{path}/model")
        for name in ("params", "score", "baseline", "search", "metrics"):
            setattr(out, name, side[name])
        return out
