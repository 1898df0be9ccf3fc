"""The parts put together: train the detectors, score flows, raise alerts, extend the blocklist."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.ml.detectors import Settings, fit_detector, score, score_all
from flowsentry.ml.features import feature_matrix
from flowsentry.ml.metrics import weighted_metrics
from flowsentry.ml.persist import save_detector
from flowsentry.ml.vote import ensemble_vote
from flowsentry.operators.alerts import alerts_from_predictions
from flowsentry.operators.blocklist import auto_blocklist, block
from flowsentry.operators.connections import flow_features
from flowsentry.operators.filters import captured
from flowsentry.operators.joins import with_advice
from flowsentry.operators.ordering import rank_rows
from flowsentry.operators.profile import bounded_sample, gathered, stratified_split
from flowsentry.schemas import DETECTORS, FLOW_FEATURES, FLOW_LABEL
from flowsentry.session import checkpointed
from flowsentry.sources.alert_table import AlertTable


def training_frame(flows: DataFrame, key: list[str]) -> DataFrame:
    """Numeric features, label and split of every flow."""
    return stratified_split(feature_matrix(flows, keep=[*key, FLOW_LABEL]), FLOW_LABEL, key)


def train_detectors(split: DataFrame, detectors: list[str] = DETECTORS,
                    settings: Settings | None = None, missing: dict[str, Exception] | None = None
                    ) -> dict[str, PipelineModel]:
    """Fit the detectors one after another on all training rows (on fewer only if `Settings.fit_rows` asks for that).

    A failure is raised. With `missing` the others go on, and the dictionary tells which detectors failed and why.
    """
    settings = settings or Settings()
    rows = split.filter(F.col("split") == "train")
    train = rows.select(*FLOW_FEATURES, FLOW_LABEL)
    if settings.fit_rows:
        key = [c for c in split.columns if c not in (*FLOW_FEATURES, FLOW_LABEL, "split")] or FLOW_FEATURES
        train = bounded_sample(rows, FLOW_LABEL, key, settings.fit_rows).select(*FLOW_FEATURES, FLOW_LABEL)
        train = gathered(train, settings.parallelism)  # bounded, and read in every iteration
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    models = {}
    for detector in detectors:
        try:
            models[detector] = fit_detector(train, detector, settings)
        except Exception as error:
            if missing is None:
                raise
            missing[detector] = error
    train.unpersist()
    return models


def train_and_save(flows: DataFrame, key: list[str], folder: str, detectors: list[str] = DETECTORS,
                   settings: Settings | None = None) -> dict[str, dict[str, float]]:
    """Train, measure on the test rows, and store every detector. Returns the metrics."""
    split = training_frame(flows, key)
    models = train_detectors(split, detectors, settings)
    results = {}
    for detector, model in models.items():
        judged = score(model, split, detector)
        metrics = {r["split"]: r.asDict() for r in
                   weighted_metrics(judged, FLOW_LABEL, detector, by=["split"]).collect()}
        test = metrics.get("test", {})
        results[detector] = {"train_accuracy": metrics["train"]["accuracy"],
                             "val_accuracy": test.get("accuracy", 0.0),
                             "precision": test.get("precision", 0.0), "recall": test.get("recall", 0.0),
                             "f1_score": test.get("f1_score", 0.0)}
        save_detector(model, flows.sparkSession, folder, detector, FLOW_FEATURES, results[detector])
    return results


def predict_flows(flows: DataFrame, models: dict[str, PipelineModel], keep: list[str]) -> DataFrame:
    """The ensemble's verdict and advice for every flow."""
    scored = score_all(models, feature_matrix(flows, keep=[*keep, F.col("SrcIP").alias("source_ip")]))
    return with_advice(ensemble_vote(scored, keep=[*keep, "source_ip"]), "prediction")


def detect(packets: DataFrame, predict: Callable[[DataFrame, list[str]], DataFrame],
           blocklist: DataFrame, into: AlertTable | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From packets to predictions, numbered alerts and the blocklist they lead to.

    `predict` takes flows and the columns to keep and gives one prediction per flow, for example
    `partial(predict_flows, models=...)`. Predictions and alerts are each computed once and kept on shared storage.
    An alert carries the time of its flow's last packet and the next free number in that order: from 1 on, or, with an
    alert table to put them into, after those of all earlier calls.
    """
    flows = flow_features(captured(packets), last_seen=True)
    key = ["SrcIP", "DstIP", "SrcPort", "DstPort"]
    named = flows.select("*", *[F.col(c).alias(f"flow_{c}") for c in key], F.col("Protocol").alias("flow_Protocol"),
                         F.col("LastSeen").alias("ts"))
    kept = ["ts", *[f"flow_{c}" for c in key], "flow_Protocol"]
    predictions = checkpointed(predict(named, kept))
    raised = alerts_from_predictions(predictions, kept)
    if into is None:
        alerts = rank_rows(raised, [F.col(c).asc() for c in kept], "id")
    else:
        first, past = into.append(raised)
        alerts = into.read().filter((F.col("id") >= first) & (F.col("id") < past)) if past > first else \
            raised.limit(0).withColumns({"id": F.lit(0).cast("bigint"), "acknowledged": F.lit(False)})
    return predictions, alerts, block(blocklist, auto_blocklist(alerts), "ip")
