"""Vector arithmetic on plain arrays, and verdicts on anomaly scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zscore(value: Column, mean: float, std: float) -> Column:
    return (value - F.lit(mean)) / F.lit(std)


def mean_squared_error(left: Column, right: Column) -> Column:
    """Mean of squared differences of two equally long arrays."""
    squares = F.zip_with(left, right, lambda a, b: (a - b) * (a - b))
    return F.aggregate(squares, F.lit(0.0), lambda total, x: total + x) / F.size(left)


def anomaly_columns(score: Column, threshold: Column) -> dict[str, Column]:
    """Verdict on a score and how far it lies from the threshold, in threshold units up to 1."""
    return {
        "is_anomaly": score > threshold,
        "anomaly_score": score,
        "threshold": threshold,
        "confidence": F.least(F.lit(1.0), F.abs(score - threshold) / threshold),
        "status": F.when(score > threshold, "ANOMALY").otherwise("NORMAL"),
    }


def clip(value: Column, low, high) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))
