"""Topic shares and truncated SVD of n-gram vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.feature import VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tabweave.plans.roles import col

TOPICS = 10
TOPICS_FROM_TERMS = 50
TOPIC_ROUNDS = 20
COMPONENTS = 100
DENSE_TERMS = 4096
SEED = 42


def topic_count(terms: int, wanted: int = TOPICS) -> int | None:
    """Number of topics, or ``None`` when the vocabulary is too small for topics."""
    return None if terms < TOPICS_FROM_TERMS else max(3, min(wanted, terms // 10))


def fit_topics(df: DataFrame, vectors: str, topics: int, seed: int = SEED) -> LDAModel:
    """Online LDA; each of the ``TOPIC_ROUNDS`` rounds reads every document. Those without any term change nothing."""
    lda = LDA(
        k=topics, maxIter=TOPIC_ROUNDS, optimizer="online", subsamplingRate=1.0, seed=seed, featuresCol=vectors, topicDistributionCol="__topics"
    )
    return lda.fit(df.select(col(vectors)))


def add_topics(df: DataFrame, vectors: str, model: LDAModel, output: str) -> DataFrame:
    """Shares of each topic; a document without any term has equal shares."""
    count = model.getK()
    made = model.setFeaturesCol(vectors).setTopicDistributionCol("__topics").transform(df)
    shares = vector_to_array("__topics")
    total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    even = F.array_repeat(F.lit(1.0 / count), count)
    made = made.select("*", array_to_vector(F.when(total > 0, shares).otherwise(even)).alias(output)).drop("__topics")
    return VectorSizeHint(inputCol=output, size=count, handleInvalid="optimistic").transform(made)


def component_count(terms: int, wanted: int = COMPONENTS) -> int | None:
    """Number of components, or ``None`` when the vocabulary is not above the wanted number."""
    return None if terms <= wanted else min(max(20, min(wanted, terms // 2)), terms)


def fit_svd(df: DataFrame, vectors: str, terms: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors and singular values of the uncentred matrix.

    One pass sums the Gram matrix, terms x terms on the driver; above the width limit Spark's
    iterative solver is used, which needs a pass per step. Signs are fixed by the largest loading.
    """
    rows = RowMatrix(MLUtils.convertVectorColumnsFromML(df.select(col(vectors)), vectors))
    if terms <= DENSE_TERMS:
        values, basis = np.linalg.eigh(rows.computeGramianMatrix().toArray())
        order = np.argsort(values)[::-1][:components]
        singular, basis = np.sqrt(np.maximum(values[order], 0.0)), basis[:, order]
    else:
        found = rows.computeSVD(components)
        singular, basis = np.asarray(found.s.toArray()), found.V.toArray()
    signs = np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])])
    return basis * signs, singular


def add_projection(df: DataFrame, vectors: str, basis: np.ndarray, output: str) -> DataFrame:
    """Project each row on the basis: one matrix product per Arrow batch."""

    @pandas_udf("array<double>")
    def project(batch: pd.Series) -> pd.Series:
        if not len(batch):
            return batch
        return pd.Series(list(np.vstack(batch.to_numpy()) @ basis))

    return df.select("*", project(vector_to_array(col(vectors))).alias(output))


def share_columns(df: DataFrame, vectors: str, count: int, prefix: str) -> DataFrame:
    """Spread a vector or an array over numbered columns."""
    packed = F.col(vectors)
    if df.schema[vectors].dataType.typeName() != "array":
        packed = vector_to_array(packed)
    others = [c for c in df.columns if c != vectors]
    spread = df.select(*[col(c) for c in others], packed.alias("__packed"))
    return spread.select(*[col(c) for c in others], *[F.col("__packed")[i].alias(f"{prefix}{i}") for i in range(count)])
