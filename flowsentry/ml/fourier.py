"""Random Fourier features: a linear model on them approximates one with an RBF kernel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class RandomFourierFeatures(Transformer, HasInputCol, HasOutputCol, HasSeed,
                            DefaultParamsReadable, DefaultParamsWritable):
    """cos(xW + b) with W and b drawn once; one matrix product per Arrow batch.

    `gamma` 0 stands for one over the number of inputs, the usual scale for standardised inputs. `drawn` fixes W
    and b as parameters, which are saved with the model, so a loaded one doesn't depend on the random generator.
    """

    weights = Param(Params._dummy(), "weights", "W, row after row", TypeConverters.toListFloat)
    offsets = Param(Params._dummy(), "offsets", "b", TypeConverters.toListFloat)

    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width, 0 for 1/inputs", TypeConverters.toFloat)

    def __init__(self, inputCol: str | None = None, outputCol: str | None = None, size: int = 128,
                 gamma: float = 0.0, seed: int = 42):
        super().__init__()
        self._setDefault(size=128, gamma=0.0, seed=42)
        self._set(size=size, gamma=gamma, seed=seed)
        if inputCol and outputCol:
            self._set(inputCol=inputCol, outputCol=outputCol)

    def drawn(self, width: int) -> RandomFourierFeatures:
        """Draw W and b for so many inputs."""
        size, random = self.getOrDefault(self.size), np.random.default_rng(self.getOrDefault(self.seed))
        spread = np.sqrt(2 * (self.getOrDefault(self.gamma) or 1.0 / width))
        self._set(weights=random.normal(scale=spread, size=(width, size)).ravel().tolist(),
                  offsets=random.uniform(0, 2 * np.pi, size).tolist())
        return self

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size = self.getOrDefault(self.size)
        weights = np.array(self.getOrDefault(self.weights)).reshape(-1, size)
        offsets = np.array(self.getOrDefault(self.offsets))

        def project(rows: pd.Series) -> pd.Series:
            if rows.empty:
                return pd.Series([], dtype=object)
            inputs = np.stack(rows.to_numpy())
            return pd.Series(list(np.sqrt(2.0 / size) * np.cos(inputs @ weights + offsets)))

        mapped = F.pandas_udf(project, T.ArrayType(T.DoubleType()))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(
            mapped(vector_to_array(self.getInputCol()))))
