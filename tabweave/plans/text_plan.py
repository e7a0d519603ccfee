"""The fitted text plan: statistics, n-grams, sentiment, topics, reduction and interactions."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.clustering import LDAModel, LocalLDAModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.operators import text_features, topics, vectorize
from tabweave.functions.wordlists import ENGLISH_STOP_WORDS
from tabweave.plans.roles import Roles, col
from tabweave.session import materialize

MAX_FEATURES = 10_000


@dataclass
class TextPlan:
    """Decisions per text column. Vocabularies and projections are data; topics are Spark models."""

    columns: list[str]
    method: str = "tfidf"
    max_features: int = MAX_FEATURES
    source: str = "cleaned"
    vocabularies: dict[str, dict] = field(default_factory=dict)
    topic_models: dict[str, LDAModel] = field(default_factory=dict)
    bases: dict[str, np.ndarray] = field(default_factory=dict)
    singular: dict[str, list[float]] = field(default_factory=dict)
    interactions: dict = field(default_factory=lambda: {"pairs": [], "nonzero": []})

    def _statistics(self, df: DataFrame) -> DataFrame:
        df = text_features.add_cleaned(df, self.columns)
        df = text_features.add_statistics(df, self.columns, self.source)
        return text_features.add_sentiment(df, self.columns)

    def _reduce(self, df: DataFrame) -> DataFrame:
        for c in self.columns:
            if c in self.topic_models:
                df = topics.add_topics(df, f"{c}_ngrams", self.topic_models[c], f"{c}_topics")
            if c in self.bases:
                df = topics.add_projection(df, f"{c}_ngrams", self.bases[c], f"{c}_svd")
                df = df.drop(f"{c}_ngrams")
        df = text_features.apply_interactions(df, self.interactions)
        return df.drop(*[f"{c}_cleaned" for c in self.columns])

    def transform(self, df: DataFrame) -> DataFrame:
        """All text features; n-grams stay one sparse vector, topics and components one each."""
        df = self._statistics(df)
        for c in self.columns:
            if c in self.vocabularies:
                df = vectorize.add_vectors(df, col(f"{c}_cleaned"), self.vocabularies[c], f"{c}_ngrams")
        return self._reduce(df)

    @property
    def numeric(self) -> list[str]:
        """Names of the plain numeric features."""
        stats = list(text_features.text_statistics(F.lit("")))
        mood = list(text_features.sentiment(F.lit(""), F.lit("")))
        out = [f"{c}_{s}" for c in self.columns for s in (*stats, *mood)]
        for a, b in self.interactions["pairs"]:
            out.append(f"{a}_x_{b}")
            if b in self.interactions["nonzero"]:
                out.append(f"{a}_div_{b}")
        return out

    @property
    def vectors(self) -> list[str]:
        """Names of the vector features."""
        out = []
        for c in self.columns:
            if c in self.topic_models:
                out.append(f"{c}_topics")
            if c in self.bases:
                out.append(f"{c}_svd")
            elif c in self.vocabularies:
                out.append(f"{c}_ngrams")
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        data = {
            "columns": self.columns,
            "method": self.method,
            "max_features": self.max_features,
            "source": self.source,
            "vocabularies": self.vocabularies,
            "bases": {c: b.tolist() for c, b in self.bases.items()},
            "singular": self.singular,
            "interactions": self.interactions,
            "topics": sorted(self.topic_models),
        }
        text = json.dumps(data, ensure_ascii=False)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/plan")
        for i, c in enumerate(sorted(self.topic_models)):
            self.topic_models[c].write().overwrite().save(f"{path}/topics-{i}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextPlan:
        data = json.loads(spark.read.text(f"{path}/plan").first()[0])
        models = {c: LocalLDAModel.load(f"{path}/topics-{i}") for i, c in enumerate(data.pop("topics"))}
        bases = {c: np.array(b) for c, b in data.pop("bases").items()}
        return cls(**data, bases=bases, topic_models=models)


def fit_text_plan(
    df: DataFrame,
    columns: list[str] | None = None,
    method: str = "tfidf",
    max_features: int = MAX_FEATURES,
    topic_modeling: bool = True,
    dimensionality_reduction: bool = True,
    language: str = "english",
    stop_words: tuple[str, ...] | None = None,
    source: str = "cleaned",
    components: int = topics.COMPONENTS,
    seed: int = topics.SEED,
) -> tuple[TextPlan, DataFrame]:
    """Fit the text features and return the plan with the transformed rows.

    Statistics and vectors are written once to the shared folder; the topic and SVD fits read
    them there.
    """
    if columns is None:
        columns = text_features.detect_text_columns(df, Roles())
    if stop_words is None:
        stop_words = ENGLISH_STOP_WORDS if language == "english" else ()
    plan = TextPlan(list(columns), method, max_features, source)
    df = materialize(plan._statistics(df), "text-statistics")
    for c in plan.columns:
        spec = vectorize.fit_vocabulary(df, col(f"{c}_cleaned"), max_features, method, stop_words)
        if spec["terms"]:
            plan.vocabularies[c] = spec
            df = vectorize.add_vectors(df, col(f"{c}_cleaned"), spec, f"{c}_ngrams")
    df = materialize(df, "text-vectors")
    for c, spec in plan.vocabularies.items():
        size = len(spec["terms"])
        count = topics.topic_count(size) if topic_modeling else None
        if count:
            plan.topic_models[c] = topics.fit_topics(df, f"{c}_ngrams", count, seed)
        kept = topics.component_count(size, components) if dimensionality_reduction else None
        if kept:
            plan.bases[c], singular = topics.fit_svd(df, f"{c}_ngrams", size, kept)
            plan.singular[c] = singular.tolist()
    plan.interactions = text_features.fit_interactions(df, plan.columns)
    return plan, plan._reduce(df)
