"""Recall under a least precision (G4) as a Spark ML evaluator, for ``CrossValidator`` and ``TrainValidationSplit``."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MIN_PRECISION_TUNING
from ..operators import metrics


class RecallAtPrecision(Evaluator, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Recall, less twice what precision lacks to ``minPrecision``. One aggregate; larger is better."""

    minPrecision = Param(Params._dummy(), "minPrecision", "least precision", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, minPrecision: float = MIN_PRECISION_TUNING, labelCol: str = "label", predictionCol: str = "prediction") -> None:
        super().__init__()
        self._setDefault(minPrecision=MIN_PRECISION_TUNING)
        self._set(**self._input_kwargs)

    def setMinPrecision(self, value: float) -> RecallAtPrecision:
        return self._set(minPrecision=value)

    def _evaluate(self, dataset: DataFrame) -> float:
        rows = dataset.select(F.lit(0).alias("run"), F.col(self.getLabelCol()).cast("int").alias("y"), F.col(self.getPredictionCol()).cast("int").alias("pred"))
        row = metrics.recall_with_min_precision(metrics.classification_metrics(rows, ["run"]), self.getOrDefault(self.minPrecision)).first()
        return float(row["recall_min_precision"]) if row is not None else 0.0

    def isLargerBetter(self) -> bool:
        return True
