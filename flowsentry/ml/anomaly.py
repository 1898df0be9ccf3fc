"""Reconstruction-error anomaly detectors fitted on normal rows: a non-linear autoencoder, and its linear form, PCA."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.functions.scores import anomaly_columns
from flowsentry.ml.network import Effort, NetworkModel, autoencoder_layers, fit_network
from flowsentry.operators.profile import STD_FLOOR, anomaly_threshold

_SHIFTED, _INPUT, _CODE, _DECODED = "_shifted", "_z", "_code", "_decoded"


@dataclass
class AnomalyDetector:
    """Standardising and coding stages, and the threshold learnt from normal rows."""

    stages: PipelineModel
    vector: str
    size: int
    mean_error: float = 0.0
    std_error: float = 0.0
    threshold: float = 0.0
    decodes: bool = False  # whether a stage gives back the input, as the autoencoder's does


def _standardising(rows: DataFrame, vector: str) -> tuple[list, int]:
    """Stages that centre and divide by the population deviation; constant features become 0."""
    scaler = StandardScaler(inputCol=vector, outputCol=_SHIFTED, withMean=True, withStd=True).fit(rows)
    count = rows.count()
    sample = scaler.std.toArray()
    population = sample * np.sqrt((count - 1) / count) + STD_FLOOR
    rescale = ElementwiseProduct(inputCol=_SHIFTED, outputCol=_INPUT,
                                 scalingVec=Vectors.dense(sample / population))
    return [scaler, rescale], len(sample)


def _with_threshold(detector: AnomalyDetector, rows: DataFrame) -> AnomalyDetector:
    learnt = anomaly_threshold(anomaly_scores(detector, rows, []), "anomaly_score").first()
    detector.mean_error, detector.std_error = learnt["mean_error"], learnt["std_error"]
    detector.threshold = learnt["threshold"]
    return detector


def fit_anomaly_detector(normal: DataFrame, vector: str = "features", size: int = 16) -> AnomalyDetector:
    """PCA, fitted on normal rows only, given as a vector column.

    Moments and covariance are combined partition by partition; what reaches the driver is features ×
    features, whatever the number of rows. Constant features standardise to 0 and add no error.
    """
    rows = normal.select(vector).persist(StorageLevel.MEMORY_AND_DISK)
    scaling, width = _standardising(rows, vector)
    ready = PipelineModel(scaling).transform(rows)
    pca = PCA(k=min(size, width), inputCol=_INPUT, outputCol=_CODE).fit(ready)
    detector = _with_threshold(AnomalyDetector(PipelineModel([*scaling, pca]), vector, width), rows)
    rows.unpersist()
    return detector


def fit_autoencoder(normal: DataFrame, vector: str = "features", size: int = 16, effort: Effort | None = None) -> AnomalyDetector:
    """The autoencoder, fitted on normal rows only. Every row takes part: mini-batches are made of all of them, and the
    threshold is that of the errors of all of them."""
    rows = normal.select(vector).persist(StorageLevel.MEMORY_AND_DISK)
    scaling, width = _standardising(rows, vector)
    ready = PipelineModel(scaling).transform(rows).select(
        vector_to_array(_INPUT).alias("features"), F.lit(None).cast("double").alias("target"))
    layers = autoencoder_layers(width, size)
    fitted = fit_network(ready, layers, width, effort)
    code = layers.index(["dense", size]) + 2  # with its activation
    stages = [NetworkModel(_INPUT, _DECODED).holding(fitted), NetworkModel(_INPUT, _CODE).holding(fitted, until=code)]
    detector = _with_threshold(AnomalyDetector(PipelineModel([*scaling, *stages]), vector, width, decodes=True), rows)
    rows.unpersist()
    return detector


def _squares(vector: str) -> Column:
    return F.aggregate(vector_to_array(vector), F.lit(0.0), lambda total, x: total + x * x)


def anomaly_scores(detector: AnomalyDetector, df: DataFrame, keep: list[str]) -> DataFrame:
    """Mean squared reconstruction error per row.

    PCA's components are orthonormal, so its squared error is what the code misses of the squared length.
    """
    missed = F.greatest(_squares(_INPUT) - _squares(_CODE), F.lit(0.0))
    if detector.decodes:
        pairs = F.zip_with(vector_to_array(_INPUT), vector_to_array(_DECODED), lambda x, y: (x - y) * (x - y))
        missed = F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)
    coded = detector.stages.transform(df.select(*keep, detector.vector))
    return coded.select(*keep, (missed / detector.size).alias("anomaly_score"))


def anomaly_verdicts(detector: AnomalyDetector, df: DataFrame, keep: list[str],
                     threshold: float | None = None) -> DataFrame:
    limit = F.lit(float(detector.threshold if threshold is None else threshold))
    columns = anomaly_columns(F.col("anomaly_score"), limit)
    return anomaly_scores(detector, df, keep).select(*keep, *[c.alias(n) for n, c in columns.items()])


def encoded_features(detector: AnomalyDetector, df: DataFrame, keep: list[str]) -> DataFrame:
    """The compressed form of every row."""
    coded = detector.stages.transform(df.select(*keep, detector.vector))
    return coded.select(*keep, vector_to_array(_CODE).alias("code"))
