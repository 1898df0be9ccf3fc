"""The detection job from packets to blocklist, with rule votes in the detectors' place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.ml.vote import ensemble_vote
from flowsentry.operators.joins import with_advice
from flowsentry.plans.detection import detect
from flowsentry.plans.registry import Tables, register


def rule_predictions(flows: DataFrame, keep: list[str]) -> DataFrame:
    """One simple rule on flow features per detector, and the ensemble's verdict on them."""
    many = F.col("NumPackets") >= 2
    votes = {"random_forest": F.when(many, "DDoS").otherwise("Normal"),
             "svm": F.when(F.col("BytesSent") > 400, "DoS").otherwise("Normal"),
             "xgboost": F.when(F.col("DstPort") % 2 == 0, "PortScan").otherwise("Normal"),
             "cnn": F.when(many | (F.col("PacketSize") > 300), F.when(F.col("Protocol") == "TCP", "DoS"))
                     .otherwise("Normal")}
    scored = flows.select(*keep, F.col("SrcIP").alias("source_ip"), *[v.alias(d) for d, v in votes.items()],
                          *[F.lit(c).alias(f"{d}_confidence") for d, c in zip(votes, (0.5, 0.75, 0.625, 0.875))])
    return with_advice(ensemble_vote(scored, keep=[*keep, "source_ip"]), "prediction")


@register
def detect_predictions(t: Tables) -> DataFrame:
    found = detect(t.packets, rule_predictions, t.blocklist)[0]
    return found.drop("details", "votes", "models_used")


@register
def detect_alerts(t: Tables) -> DataFrame:
    return detect(t.packets, rule_predictions, t.blocklist)[1].drop("message")


@register
def detect_blocklist(t: Tables) -> DataFrame:
    return detect(t.packets, rule_predictions, t.blocklist)[2]
