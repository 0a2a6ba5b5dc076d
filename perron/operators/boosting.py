"""GBM-01: gradient boosting with absolute loss by the trees that Spark has."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame


def fit(train: DataFrame, columns: list[str], target: str, *, trees: int = 50, depth: int = 5, step: float = 0.1, seed: int = 42, holdout: str | None = None) -> PipelineModel:
    """A model of ``columns``; with a boolean column ``holdout``, boosting ends when its rows improve no more."""
    vector = VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="keep")
    boost = GBTRegressor(featuresCol="_x", labelCol=target, predictionCol="pred", lossType="absolute", maxIter=trees, maxDepth=depth, stepSize=step, seed=seed)
    if holdout:
        boost = boost.setValidationIndicatorCol(holdout)
    return PipelineModel([vector, boost.fit(vector.transform(train))])


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).drop("_x")


def gains(model: PipelineModel, columns: list[str]) -> list[tuple[str, float]]:
    """(feature, gain) of the fitted trees, for ``rows.top_features``."""
    return [(c, float(g)) for c, g in zip(columns, model.stages[-1].featureImportances.toArray())]
