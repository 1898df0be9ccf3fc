"""Saving and loading detectors with what is needed to use them."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from flowsentry.ml.anomaly import AnomalyDetector
from flowsentry.schemas import DETECTORS
from flowsentry.sources.files import exists


def _write_json(spark: SparkSession, value: dict, path: str) -> None:
    spark.range(1, numPartitions=1).select(F.lit(json.dumps(value))).write.mode("overwrite").text(path)


def _read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def save_detector(model: PipelineModel, spark: SparkSession, folder: str, detector: str,
                  features: list[str], metrics: dict[str, float] | None = None) -> None:
    """The fitted pipeline, scaler and label names included, beside its feature names and metrics."""
    model.write().overwrite().save(f"{folder}/{detector}/model")
    _write_json(spark, {"feature_names": features, "metrics": metrics or {}},
                f"{folder}/{detector}/metadata")


def load_detector(spark: SparkSession, folder: str, detector: str) -> tuple[PipelineModel, dict]:
    return (PipelineModel.load(f"{folder}/{detector}/model"),
            _read_json(spark, f"{folder}/{detector}/metadata"))


def load_detectors(spark: SparkSession, folder: str, detectors: list[str] = DETECTORS,
                   missing: list[str] | None = None) -> dict[str, PipelineModel]:
    """The named detectors of a folder. One that isn't there is an error; with `missing` it has no vote and is added
    to that list. One that is there but can't be read is always an error."""
    models = {}
    for detector in detectors:
        if missing is not None and not exists(spark, f"{folder}/{detector}/model"):
            missing.append(detector)
        else:
            models[detector] = load_detector(spark, folder, detector)[0]
    return models


def save_anomaly_detector(detector: AnomalyDetector, spark: SparkSession, folder: str) -> None:
    detector.stages.write().overwrite().save(f"{folder}/anomaly/model")
    learnt = {"vector": detector.vector, "size": detector.size, "mean_error": detector.mean_error,
              "std_error": detector.std_error, "threshold": detector.threshold, "decodes": detector.decodes}
    _write_json(spark, learnt, f"{folder}/anomaly/metadata")


def load_anomaly_detector(spark: SparkSession, folder: str) -> AnomalyDetector:
    stages = PipelineModel.load(f"{folder}/anomaly/model")
    return AnomalyDetector(stages, **_read_json(spark, f"{folder}/anomaly/metadata"))
