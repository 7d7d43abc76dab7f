"""Models with stated weights behind the interface of fitted ones.

They let SQL recompute everything that is done with a model; fitted models are checked by invariants.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LinearScore:
    """Weighted sum of the `features` vector as the score of class 1."""

    def __init__(self, weights: list[float]):
        self.weights = weights
        self.featureImportances = self

    def toArray(self) -> np.ndarray:  # noqa: N802  (the name that vectors have)
        size = np.abs(np.array(self.weights))
        return size / size.sum()

    def transform(self, df: DataFrame) -> DataFrame:
        v = vector_to_array("features")
        score = reduce(add, [F.lit(w) * F.element_at(v, i + 1) for i, w in enumerate(self.weights)])
        return df.withColumn("probability", array_to_vector(F.array(F.lit(1.0) - score, score)))


class ColumnScore:
    """A column that already holds the score of class 1."""

    def __init__(self, column: str):
        self.column = column

    def transform(self, df: DataFrame) -> DataFrame:
        p = F.col(self.column)
        return df.withColumn("probability", array_to_vector(F.array(F.lit(1.0) - p, p)))
