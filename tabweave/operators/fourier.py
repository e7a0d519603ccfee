"""Random Fourier features: a map whose inner products approximate the RBF kernel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf

SIZE = 256


def fourier_weights(seed: int, gamma: float, width: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """W and b of the map."""
    draw = np.random.RandomState(seed)
    weights = draw.normal(scale=np.sqrt(2 * gamma), size=(width, size))
    return weights, draw.uniform(0, 2 * np.pi, size=size)


class FourierMap(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """``x -> sqrt(2/size) cos(Wx + b)`` with rows of W drawn from N(0, 2 gamma) by seed.

    W follows from the seed and the sizes, so only these are saved (Rahimi and Recht, NIPS 2007).
    """

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    width = Param(Params._dummy(), "width", "input dimensions", TypeConverters.toInt)
    size = Param(Params._dummy(), "size", "output dimensions", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, gamma=1.0, width=1, size=SIZE, seed=42):
        super().__init__()
        self._setDefault(gamma=1.0, width=1, size=SIZE, seed=42)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights, shift = fourier_weights(*(self.getOrDefault(p) for p in (self.seed, self.gamma, self.width, self.size)))
        scale = np.sqrt(2 / self.getOrDefault(self.size))

        @pandas_udf("array<double>")
        def spread(batch: pd.Series) -> pd.Series:
            if not len(batch):
                return batch
            return pd.Series(list(scale * np.cos(np.vstack(batch.to_numpy()) @ weights + shift)))

        source = vector_to_array(dataset[self.getInputCol()])
        return dataset.withColumn(self.getOutputCol(), array_to_vector(spread(source)))
