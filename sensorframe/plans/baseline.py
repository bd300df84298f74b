"""A distributed baseline: weighted linear readout of window-mean channels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from sensorframe.functions import vec as V


def fit_baseline(windows: DataFrame, features: Sequence[str], weight: str = "weight",
                 ridge: float = 1e-6) -> dict[str, PipelineModel]:
    """One weighted least-squares model per velocity axis."""
    table = VectorAssembler(inputCols=list(features), outputCol="_features").transform(windows)
    return {c: LinearRegression(featuresCol="_features", labelCol=c, weightCol=weight,
                                predictionCol=f"{c}_pred", regParam=ridge, solver="normal"
                                ).fit(table) for c in V.VEL}


def predict_baseline(windows: DataFrame, models, features: Sequence[str],
                     keep: Sequence[str] = ("rec", "win_idx")) -> DataFrame:
    out = VectorAssembler(inputCols=list(features), outputCol="_features").transform(windows)
    for model in models.values():
        out = model.transform(out)
    return out.select(*keep, *[F.col(f"{c}_pred").alias(c) for c in V.VEL])
