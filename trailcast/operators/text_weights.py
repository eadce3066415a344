"""TF-IDF with dampened term frequencies and unit length, as pipeline stages.

A term that occurs tf times in a text weighs (1 + ln tf) (1 + ln((1 + n) / (1 + df))), n texts of which
df have the term; every text's weights are then divided by their Euclidean length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import IDF
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F


def weigh(counts: pd.DataFrame, idf: np.ndarray) -> pd.DataFrame:
    """Sparse count vectors of a batch (size, indices, values) to unit-length weights, all rows at once."""
    sizes = counts["indices"].map(len).to_numpy(np.int64)
    if sizes.sum():
        at = np.concatenate(counts["indices"].to_list()).astype(np.int64)
        weights = (1.0 + np.log(np.concatenate(counts["values"].to_list()))) * idf[at]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        length = np.sqrt(np.bincount(owner, weights * weights, len(sizes)))
        parts = np.split(weights / length[owner], np.cumsum(sizes)[:-1])
    else:
        parts = [np.zeros(0)] * len(counts)
    return pd.DataFrame({"type": np.zeros(len(counts), np.int8), "size": counts["size"].astype("int32"),
                         "indices": counts["indices"], "values": pd.Series(parts, index=counts.index)})


class SublinearTfIdf(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fits document frequencies on a column of term counts (sparse vectors)."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> SublinearTfIdfModel:
        fitted = IDF(inputCol=self.getInputCol(), outputCol="_unused").fit(dataset)
        model = SublinearTfIdfModel(inputCol=self.getInputCol(), outputCol=self.getOutputCol())
        return model._set(idf=(fitted.idf.toArray() + 1.0).tolist())


class SublinearTfIdfModel(Model, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    idf = Param(Params._dummy(), "idf", "weight of each term", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        idf = np.array(self.getOrDefault(self.idf))

        @F.pandas_udf(VectorUDT())
        def weights(counts: pd.DataFrame) -> pd.DataFrame:
            return weigh(counts, idf)

        return dataset.withColumn(self.getOutputCol(), weights(F.unwrap_udt(F.col(self.getInputCol()))))
