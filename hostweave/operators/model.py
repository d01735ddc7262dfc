"""Detectors: class-weighted MLlib models, scored once, reported as average precision."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostweave.operators.metrics import average_precision, balanced_weights, pr_curve

GBT = {"maxDepth": 3, "maxIter": 100, "stepSize": 0.1, "subsamplingRate": 0.8, "minInstancesPerNode": 5}
MODELS = ("gbt", "logistic")


@dataclass
class Fitted:
    model: PipelineModel
    scored: DataFrame
    auc_pr: float
    features: list[str]

    def curve(self) -> DataFrame:
        return pr_curve(self.scored)

    def importances(self) -> dict[str, float]:
        last = self.model.stages[-1]
        values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else [abs(x) for x in last.coefficients.toArray()]
        return dict(sorted(zip(self.features, map(float, values), strict=True), key=lambda x: (-x[1], x[0])))


def train_and_eval(train: DataFrame, evaluation: DataFrame, features: list[str], *, model: str = "gbt", seed: int = 0, params: dict | None = None, single_partition: bool = False) -> Fitted:
    """Fits on train (label, features) with balanced weights and scores evaluation (label, features, ...) once.

    The scaler of the logistic model sees train only. Rows are dealt to partitions by their values and sorted there, so
    that a subsampled GBT repeats for the same rows and number of partitions; single_partition makes it repeat whatever
    that number is, for training sets that fit one executor.
    """
    if model not in MODELS:
        raise ValueError(f"no detector is named {model!r}; there are {' and '.join(MODELS)}")
    rows = balanced_weights(train).withColumn("label", F.col("label").cast("double"))
    if single_partition:
        rows = rows.coalesce(1).sortWithinPartitions("label", *features)
    elif model == "gbt":
        parts = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(parts, F.xxhash64("label", *features)).sortWithinPartitions("label", *features)
    if model == "gbt":
        stages = [VectorAssembler(inputCols=features, outputCol="features"), GBTClassifier(weightCol="weight", seed=seed, **(params or GBT))]
    else:
        settings = {"maxIter": 1000, "regParam": 1.0 / max(1, train.count())} | (params or {})
        stages = [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(weightCol="weight", **settings)]
    fitted = Pipeline(stages=stages).fit(rows)
    scored = fitted.transform(evaluation).withColumn("score", vector_to_array("probability")[1]).drop("raw", "features", "rawPrediction", "probability", "prediction")
    return Fitted(fitted, scored, average_precision(scored).first()[0], features)
